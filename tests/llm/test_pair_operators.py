"""SimHash, embeddings, repeated bytes, components, and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from folioscope.llm import embeddings, simhash, substrings
from folioscope.operators.components import connected_components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 105), (105, 103), (7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 103: 100, 105: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_equal_the_definition():
    def plain(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rng = random.Random(1)
    for text in ["", " \t\n", "One", "a b c", "É a b C\x0bd e", "x\x85y z w v\xa0u", *(" ".join(rng.choice("abcDEé") for _ in range(k)) for k in range(40))]:
        assert simhash.fingerprint(text.encode()) == plain(text)


def test_hamming_links_lose_nothing(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    n = len(prints)
    linked = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    label = plain_components(n, linked)
    got = {r["fp"]: r["component"] for r in simhash.components(spark.createDataFrame([(k, signed(x)) for k, x in enumerate(prints)], "id long, fp long")).collect()}
    assert [got[signed(x)] for x in prints] == label


def test_near_copies_in_documents(spark):
    base = " ".join(f"word{k}" for k in range(400))
    texts = [base, base + " more", base, None, "", "   ", "something else entirely here", base.upper()]
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)] + [(None, base, 0, 0)], "doc_id long, text string, fp int, gone int")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 0, None: 0}
    kept = simhash.keep_one_each(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "3", "6", "None"] and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = []
    for k in range(40):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        vectors += [(centre + rng.standard_normal(64) * rng.choice([0.01, 0.03])).astype(np.float32) for _ in range(150 if k == 0 else int(rng.integers(1, 20)))]
    vectors += vectors[:20]
    odd = [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [None] * 64), (9004, []), (9005, [1.0, 2.0])]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + odd, "vec_id long, embedding array<float>")
    got = {r["id"]: r for r in embeddings.near_duplicates(df, block=32).collect()}
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    degree = np.array([got[k]["n_links"] for k in range(len(vectors))])
    assert (degree <= near.sum(1)).all() and degree.sum() >= 0.98 * near.sum()
    label = plain_components(len(vectors), list(zip(*np.nonzero(near), strict=True)))
    assert sum(got[k]["component_id"] != label[k] for k in range(len(vectors))) <= 2
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k, _ in odd)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def plain_removal(rows, window=50):
    least = {}
    for doc, text in rows:
        for i in range(len(text) - window + 1):
            s = text[i : i + window]
            least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - window + 1):
            if least[text[i : i + window]] < doc:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, small):
    if small:  # many groups, pieces and flushes
        for name, value in (("GROUP_BYTES", 20_000), ("DOCUMENT_BYTES", 10_000), ("_PIECE_BYTES", 5_000), ("_FLUSH_PHRASES", 1_000)):
            monkeypatch.setattr(substrings, name, value)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 30))) for _ in range(12)]
    rows = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 10)):
            c, p = rng.random(), rng.choice(passages)
            parts.append(
                p[rng.randint(0, 40) : len(p) - rng.randint(0, 40)] if c < 0.4 else "ab" * rng.randint(20, 90) if c < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))
            )
        rows.append((rng.randint(0, 120), " ".join(parts)))
    rows += rows[:10] + [(500 + k, rows[5][1]) for k in range(5)]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, "x" * 200, 1), (777, None, 1), (778, "", 1)], "doc_id long, text string, target int")
    got = [(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.remove_repeats(df).collect()]
    assert [g[:3] for g in got if g[0] is None] == [(None, 200, 0)]
    assert sorted(g for g in got if g[0] is not None) == plain_removal([(d, t.encode()) for d, t in rows] + [(777, b""), (778, b"")])


def test_nothing_repeats(spark):
    df = spark.createDataFrame([(1, "short"), (2, "q" * 10)], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in substrings.remove_repeats(df).collect()) == [0, 0]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(f"word{k}" for k in range(200))
    item = " ".join(f"item{k}" for k in range(12))
    docs = [(1, base, "en", "src0", 5), (2, base + " tail", "en", "src0", 5), (3, "river stone " + item, "en", "src1", 5), (4, "password=abcdef12 river", "en", None, 5), (5, "a quiet river bank", "de", "src2", 18), (6, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [1, 4, 5, 6] and out[4]["text"] == "[assign] river" and out[4]["n_chars"] == 14 and out[6]["text"] is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "secrets", "source_mix"]
    assert {"doc_id", "text", "lang", "source", "n_chars", "mix_slot"} <= set(out[1].asDict())
