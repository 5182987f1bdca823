"""The pipeline's near-copy stage against brute force over five-word shingles."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import nearcopies, simhash


def test_stage_joins_all_pairs_from_four_fifths_on(spark):
    rng = random.Random(5)
    texts = [None, "", "  ", "two words", "Two  WORDS", "two other words"]
    for _ in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(400)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    scores = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0 for i in range(len(texts)) for j in range(i)}
    for _ in texts:
        for (i, j), score in scores.items():
            if score >= 0.8:
                label[i] = label[j] = min(label[i], label[j])
    assert sum(0.8 <= s < 0.95 for s in scores.values()) > 50 and sum(0.6 <= s < 0.8 for s in scores.values()) > 10
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    assert got == dict(enumerate(label))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if label[k] == k]


def test_null_and_repeated_ids(spark):
    """Rows are decided one by one: a text whose only row is under a repeated id stays."""
    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:95], "x", *base[96:]])
    rows = [(None, " ".join(base)), (3, near), (5, " ".join(base)), (5, "another text under an id that goes elsewhere"), (7, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = nearcopies.keep_one_each(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("3", near), ("5", rows[3][1]), ("7", "alone"), ("None", " ".join(base))]
    assert nearcopies.keep_one_each(docs.limit(0)).count() == 0


def test_repeated_ids_lose_no_text(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(5, a, 1), (9, a, 2), (5, b, 3), (2, b, 4)], "doc_id long, text string, gone_id int")
    for keep in (nearcopies.keep_one_each, simhash.keep_one_each):
        kept = keep(docs)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"], r["gone_id"]) for r in kept.collect()) == [(2, 4), (5, 1)]


def test_wide_chains_keep_what_the_budget_keeps(spark):
    """A pair passes exactly if it is within the budget: chains lose nothing."""
    rng = random.Random(3)
    rows = []
    for k in range(200):
        x = rng.getrandbits(256)
        y = x
        for bit in rng.sample(range(256), rng.randint(60, 130)):
            y ^= 1 << bit
        rows.append((k, bin(x ^ y).count("1"), *[[int.from_bytes((v >> (64 * j) & (2**64 - 1)).to_bytes(8, "big"), "big", signed=True) for j in range(4)] for v in (x, y)]))
    got = spark.createDataFrame([(k, d, [v - 2**64 if v >= 2**63 else v for v in x], [v - 2**64 if v >= 2**63 else v for v in y]) for k, d, x, y in rows], "k int, d int, x array<long>, y array<long>")
    found = got.select("d", simhash.ring_near(F.col("x"), F.col("y"), 96).alias("near")).collect()
    assert all(r["near"] == (r["d"] <= 96) for r in found) and 20 < sum(r["near"] for r in found) < 180


def test_chains_of_segments_lose_no_pair():
    """Pairs of similarity 0.8 or more share a key from which the chain holds, whether
    segments are enough (the usual load) or most sets must offer their empty ones, too."""
    rng = np.random.default_rng(1)
    wild = 0
    for load in (None, 12.0):
        maker = nearcopies.Segments()
        maker.load = load or maker.load
        for _ in range(400):
            n = int(np.exp(rng.uniform(np.log(4), np.log(1500))))
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            gone, new = rng.multinomial(rng.integers(0, maker.budget(n) + 1), [0.5, 0.5])
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, new, np.uint64)]))
            differing = len(np.setxor1d(a, b))
            if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
                continue
            common = set(maker.counts(len(a))) & set(maker.counts(len(b)))
            assert common or not differing
            for m in common:
                x, y = maker.fingerprint(a, m), maker.fingerprint(b, m)
                assert np.count_nonzero(x != y) <= differing
                ring, budget = max(np.count_nonzero(x), np.count_nonzero(y)), (len(a) + len(b)) / 9 + 1e-6
                keys, others = maker.keys(x, len(a)), maker.keys(y, len(b))
                wild += maker.wild(len(a), np.count_nonzero(x))

                def holds(k, x=x, y=y, ring=ring, budget=budget, m=m):
                    seen, apart = 1, 0
                    for j in range(1, nearcopies.CHAIN):
                        u, v = x[(k + j) % m], y[(k + j) % m]
                        seen, apart = seen + bool(u or v), apart + bool(u != v)
                        if apart * ring > seen * budget:
                            return False
                    return True

                assert any(holds(k) for k in np.flatnonzero((keys == others) & (keys != 0)))
    assert wild > 20


def test_pairs_at_the_bound_across_size_classes(spark):
    """Pairs of exactly 0.8 are linked, those one shingle below aren't; rows with null ids repeat."""
    rows, expected = [(None, "null id " * 9), (None, "null id " * 9)], {}
    for smaller, larger, linked in [(4, 5, True), (4, 6, False), (100, 125, True), (104, 130, True), (103, 130, False), (412, 515, True), (411, 515, False), (2000, 2500, True)]:
        words = [f"s{larger}x{smaller}w{k}" for k in range(larger + 4)]
        k = len(rows)
        rows += [(k, " ".join(words)), (k + 1, " ".join(words[: smaller + 4]))]
        expected |= {k: k, k + 1: k if linked else k + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = nearcopies.near_copies(docs).collect()
    assert {r["id"]: r["component_id"] for r in found if r["id"] is not None} == expected
    assert len(found) == len(rows) and nearcopies.keep_one_each(docs).count() == 2 + len(set(expected.values()))


def test_texts_just_below_the_bound_do_not_meet_a_whole_group(spark, monkeypatch):
    """80 near-copies of a text and 40 texts that are alike, but not enough: what is verified
    grows with the texts, not with the pairs."""
    rng = random.Random(11)
    base, rows = [f"w{j}" for j in range(149)], []
    for k in range(120):
        words = list(base)
        for j in range(1 if k < 80 else 5):
            words[rng.randrange(10, 20) + 25 * j] = f"own{k}x{j}"
        rows.append((k, " ".join(words)))
    verified, met = nearcopies._verified, []

    def counted(pairs, sets, similarity):
        met.append(pairs.count())
        return verified(pairs, sets, similarity)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    found = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["component_id"] for r in found.collect()} == {k: 0 if k < 80 else k for k in range(120)}
    assert sum(met) <= 600


def test_rows_of_similar_sets_meet_whatever_the_levels(spark):
    """Odd sketches are a lower bound, and pairs share a key that passes in Spark, too."""
    rng = np.random.default_rng(2)
    maker, rows, expected = nearcopies.Segments(), [], 0
    for pair in range(200):
        n = int(np.exp(rng.uniform(np.log(6), np.log(900))))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        gone, new = rng.multinomial(rng.integers(0, maker.budget(n) + 1), [0.5, 0.5])
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, new, np.uint64)]))
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        odd = [nearcopies.odd_sketch(x) for x in (a, b)]
        assert np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
        for m in (set(maker.counts(len(a))) & set(maker.counts(len(b)))) or {None}:
            if m is None:
                continue
            expected += 1
            prints = [maker.fingerprint(x, m) for x in (a, b)]
            keys = [maker.keys(p, len(x)) for p, x in zip(prints, (a, b), strict=True)]
            for side, (x, segments, own, other) in enumerate(zip((a, b), prints, keys, keys[::-1], strict=True)):
                shared = own[(own != 0) & (np.isin(own, other) | (own % np.uint64(5) < 2))]
                levels = np.uint64(4 * 256) + (shared >> np.uint64(8)) % np.uint64(20_000)
                items, _, level, ring, *following = nearcopies.chain_rows(maker, segments, len(x), shared, levels)
                rows += [(f"{pair}-{m}", side, *(int(v) for v in (item, side, len(x), level, ring, *rest, *odd[side]))) for item, *rest in zip(items.view(np.int64), *(f.view(np.int64) for f in following), strict=True)]
    names = ["n", "level", "ring", "following", "nearer", "farther", *nearcopies._ODD]
    table = spark.createDataFrame(rows, "pair string, side int, item long, short long, " + ", ".join(f"{c} {'int' if c in names[:3] else 'long'}" for c in names))
    a, b = (table.filter(f"side = {k}").select("pair", "item", F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{c}_{x}") for c in names[1:]]) for k, x in enumerate("ab"))
    assert a.join(b, ["pair", "item"]).filter(nearcopies._chained(0.8)).select("pair").distinct().count() == expected > 100
