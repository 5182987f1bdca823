"""Cycles of more than a hundred documents."""

from folioscope.operators import graph


def test_a_cycle_of_any_length_is_found(spark):
    n = 103
    links = spark.createDataFrame([(k, (k + 1) % n) for k in range(n)], "src long, dst long").coalesce(1)
    got = graph.cycles(links).collect()
    assert [(r["nodes"], r["length"]) for r in got] == [(list(range(n)), n)]
