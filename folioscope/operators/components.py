"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = links.union(links.select("lo", "hi")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    given = both.filter(F.col("other") > F.col("node")).join(least, "node")
    return given.select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    given = links.join(least, "hi").filter(F.col("lo") != F.col("least")).select("lo", "least")
    return given.union(least).toDF("hi", "lo").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node that has a link; label is the component's
    smallest node.

    Alternates large-star and small-star rounds, which ends after a number of
    rounds that is logarithmic in the component's size, whatever its shape. Each
    round is cut off with a checkpoint. Links with a null end or from a node to
    itself are ignored; no links give no rows.
    """
    ends = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("a"), F.col(b).alias("b"))
    now = cut_lineage(ends.filter(F.col("a") != F.col("b")).select("hi", "lo").distinct())
    state = _state(now)
    while state[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    labels = now.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return labels.union(roots)
