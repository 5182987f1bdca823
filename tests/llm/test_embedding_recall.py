"""Embedding near-copies where vectors share a direction, against brute force."""

import numpy as np
import pytest

from folioscope.llm import embeddings


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cone(rng, n, cosine):
    return unit(np.sqrt(cosine) * unit(rng.standard_normal((1, 64))) + np.sqrt(1 - cosine) * unit(rng.standard_normal((n, 64))))


def with_copies(rng, x, cosine=0.951):
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    return np.vstack([x, cosine * x + np.sqrt(1 - cosine**2) * unit(away)])


def data(kind):
    rng = np.random.default_rng(3)
    if kind == "spread":
        return with_copies(rng, unit(rng.standard_normal((2000, 64))))
    if kind in ("half", "most"):
        return with_copies(rng, cone(rng, 2000, {"half": 0.5, "most": 0.8}[kind]))
    n = {"cone 70": 1400, "cone 80": 1600}[kind]
    return np.vstack([cone(rng, n, 0.955), unit(rng.standard_normal((2000 - n, 64)))])


@pytest.mark.parametrize("kind", ["spread", "half", "most", "cone 70", "cone 80"])
def test_codes_find_pairs_of_any_shape_of_data(kind):
    x = data(kind)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    codes = embeddings.fit(x)
    own = codes.of(x)
    recall = (codes.first_table(own[i], own[j]) < codes.tables).mean()
    print(kind, len(i), "pairs; recall", round(recall, 4), "rotations", len(codes.maps), "radius", codes.radius, "centred" if codes.mean.any() else "not centred")
    assert recall >= 0.995
    if kind == "spread":
        assert len(codes.maps) == embeddings.ROTATIONS


def test_operator_on_vectors_that_share_a_direction(spark):
    x = data("most")
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.995 * near.sum() and all(got[k] <= near[k].sum() for k in got)


def test_lengths_are_compared_each(spark):
    """Vectors of a length that few have are compared, too, with their own length only."""
    rng = np.random.default_rng(5)
    usual, few = unit(rng.standard_normal((80, 16))), unit(rng.standard_normal((6, 5)))
    near = unit(few[:3] + 0.02 * rng.standard_normal((3, 5)))
    rows = [*usual.tolist(), *few.tolist(), *near.tolist(), usual[0].tolist(), [1.0], [2.0], [-1.0]]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, node int, codes int")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}

    def linked(a, b):
        return len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    links = {k: [j for j, w in enumerate(rows) if j != k and linked(v, w)] for k, v in enumerate(rows)}
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in links.items()}
    assert sum(map(len, links.values())) >= 10
    assert [got[80 + k][1] for k in range(3)] == [80 + k for k in range(3)] and [got[86 + k][1] for k in range(3)] == [80 + k for k in range(3)]


def test_dense_buckets_are_compared_in_bounded_pieces(spark):
    """A group larger than a block, on both sides of the threshold, equals brute force."""
    rng = np.random.default_rng(6)
    x = unit(unit(rng.standard_normal((1, 32))) + 0.045 * rng.standard_normal((700, 32)))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert 0.2 < near.mean() < 0.98
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["id"]: r["n_links"] for r in embeddings.near_duplicates(df, block=100).collect()}
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[k] <= near[k].sum() for k in got)
