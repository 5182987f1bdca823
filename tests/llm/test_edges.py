"""Very long texts, repeated rows, clashing names, ties and empty tables; and the
registered queries that SQL can't express, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import chat, decontam, licenses, mixing, queries, secrets, substrings, tokens, toxicity

LONG = 400_000


# --- token counts: white space of any length ------------------------------------------


def test_token_counts_of_long_white_space():
    encoding = tokens.encoder(tokens.read_vocabulary(tokens.DEFAULT_RANKS))
    for space in (" ", "\n", " \t", "\u3000", "\r\n "):
        for before, after in (("", ""), ("word", ""), ("", "word"), ("word.", "7 more"), ("a", ", b")):
            text = before + (space * 1500)[:1500] + after
            assert tokens.count_tokens(encoding, text) == len(encoding.encode_ordinary(text))
    for size in (1_000_500, 3_000_000):
        assert tokens.count_tokens(encoding, "a" + " " * size + "b") == len(encoding._encode_single_piece(" " * (size - 1))) + 2
        assert tokens.count_tokens(encoding, "\n" * size) == len(encoding._encode_single_piece("\n" * size))
    assert tokens.count_tokens(encoding, "x" * 2_000_000) > 0 and tokens.count_tokens(encoding, "7" * 2_000_000) > 0


def test_token_counts_query(spark, tmp_path):
    texts = [None, "", "one", "one", "a" + " " * 1_200_000 + "b", "two words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["n_tokens"]: r["n_docs"] for r in queries.op8_token_counts(spark, str(tmp_path)).collect()}
    assert sum(got.values()) == 6 and got[0] == 2 and max(got) > 100_000


# --- mixing: which block, place and slot each document gets ---------------------------


@pytest.mark.parametrize("units", [64, 1 << 24])
def test_places_equal_plain_prefix_sums(spark, monkeypatch, units):
    monkeypatch.setattr(mixing, "RANGE_UNITS", units)
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None]), "x" * rng.choice([0, 1, 5, 300]), 0) for k in range(200)] + [(500, "a", "y" * LONG, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, range int")
    targets = {"a": 6, "b": 2, mixing.SHARED: 4}
    keys = {r["doc_id"]: r["k"] for r in df.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    got = {r["doc_id"]: r for r in mixing.mix(df, targets, block_units=500).collect()}
    spent, places = {}, {}
    fine = lambda k: (keys[k] % 2**64) >> 44
    for k, source, text, _ in sorted(rows, key=lambda r: (fine(r[0]), keys[r[0]]) if units == 64 else keys[r[0]]):
        klass = source if source in ("a", "b") else None
        at = spent.get(klass, 0)
        places[k] = (klass, at // 500, at % 500)
        spent[klass] = at + max(1, len(text or ""))
    assert all((got[k]["mix_block"], got[k]["mix_place"]) == places[k][1:] for k in places)
    number = {"a": 1, "b": 2, None: 0}
    weights = {1: 3, 2: 1, 0: 2}
    phases, table = mixing.schedule({number[c]: -(-n // 500) for c, n in spent.items()}, weights)
    slots = {(p, c, k): s for p, c, k, s in table}
    for k, (klass, block, _) in places.items():
        p = next(p for p in phases if p.klass == number[klass] and p.first <= block < p.first + p.count)
        j = block - p.first
        assert got[k]["mix_slot"] == p.base + j // p.weight * p.total + slots[p.phase, p.klass, j % p.weight]


def test_schedules_beyond_the_bound_are_refused(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    with pytest.raises(ValueError):
        mixing.mix(df, {f"s{k}": 101 + k for k in range(1000)})
    assert mixing.mix(df, {"a": 10_000_000, mixing.SHARED: 10_000_000}).count() == 1  # one to one


# --- SimHash: the registered query ----------------------------------------------------


def plain_print(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " ", "one", "ONE", "long " * 50_000]
    for _ in range(40):
        base = [f"w{rng.randrange(90)}" for _ in range(rng.randint(3, 250))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(3, "ONE"), (0, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_print(t) for _, t in rows]
    label = [d for d, _ in rows]
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, str(tmp_path)).collect())
    assert got == sorted((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, label, strict=True))


# --- toxicity: matches, exceptions and features by hand -------------------------------


def plain_total(model, folded):
    weights, total = dict(model.lexicon), 0.0
    covered = set()
    for phrase in model.exceptions:
        p = toxicity.fold(phrase)
        at = folded.find(p)
        while at >= 0:
            covered |= set(range(at, at + len(p) - 1))
            at = folded.find(p, at + 1)
    for at in range(len(folded)):
        found = [p for p in weights if folded.startswith(p, at)]
        if found and at not in covered:
            total += weights[max(found, key=len)]
    return total


def test_matches_equal_brute_force():
    rng = random.Random(10)
    words = ["trash", "trashy", "can", "stupid", "question", "river", "tra", "moron"]
    model = toxicity.Model(((" trash", 2.0), (" trash ", 3.0), (" stupid ", 1.5), (" mor", 1.0)), toxicity.EXCEPTIONS, (0.1, 0.5, 0.2, -0.3))
    own = toxicity.matcher(model)
    for _ in range(400):
        text = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
        assert abs(own.total(text) - plain_total(model, text)) < 1e-9, text
    assert own.features(toxicity.fold(""))[3] == 0.0 and own.features(toxicity.fold("a"))[3] > 0.0
    long = toxicity.fold("trash can trash " * 100_000)
    assert abs(own.total(long) - 3.0 * 100_000) < 1e-6


def test_disguises_at_either_end_of_a_word():
    for text, word in (("5h1t", "shit"), ("$h1t!", "shit"), ("h4t3", "hate"), ("idi07", "idiot"), ("1d10t", "idiot"), ("B@d", "bad")):
        assert toxicity.fold(text).strip() == word, text
    assert toxicity.fold("2019 4$$ !!! wow!").strip() == "wow"
    assert len(toxicity.fold("a" * 2_000_000)) == 2_000_002 and toxicity.fold("1" * 2_000_000).strip() == ""


def test_toxicity_of_long_repeated_and_tied_rows(spark):
    model = toxicity.Model(((" moron ", 3.0),), (), (-4.0, 4.0, 0.0, 0.0))
    rows = [(1, "moron " * LONG, 0), (1, "moron " * LONG, 0), (2, "calm " * LONG, 0), (3, None, 0), (None, "moron moron", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = toxicity.score(df.drop("score"), model).collect()
    assert sorted((str(r["doc_id"]), r["score"] > 0.7) for r in got) == [("1", True), ("1", True), ("2", False), ("3", False), ("None", True)]
    assert toxicity.reject_toxic(df, model).columns == df.columns and toxicity.reject_toxic(df.limit(0), model).count() == 0
    tie = toxicity.Model((), (), (0.0, 0.0, 0.0, 0.0))
    assert toxicity.reject_toxic(df, tie, threshold=0.5).count() == 0 and toxicity.score(df.drop("score").limit(0), model).count() == 0


# --- long texts and repeated rows of the others ---------------------------------------


def test_long_and_repeated_texts(spark):
    filler = "".join(f"w{k} " for k in range(80_000))
    mit = licenses.TEMPLATES[0][0]
    text = filler + "password=abcdef12 " + mit + " under the mit license " + filler
    docs = spark.createDataFrame([(1, text, 1), (1, text, 1), (2, "short", 1)], "doc_id long, text string, words int")
    found = sorted((r["doc_id"], len(r["f"])) for r in secrets.find_secrets(docs, spans="f").collect())
    assert found == [(1, 1), (1, 1), (2, 0)]
    assert sorted((r["doc_id"], len(r["text"])) for r in secrets.redact(docs).collect())[0] == (1, len(text) - len("password=abcdef12") + len("[assign]"))
    labels = [(r["doc_id"], sorted({b["label"] for b in r["f"]["blocks"]}), [tuple(p) for p in r["f"]["places"]]) for r in licenses.find_licenses(docs, found="f").collect()]
    first = 80_000 + 2 + len(mit.split())
    assert sorted(map(str, labels)) == sorted(map(str, [(1, ["mit"], [("mit", first)])] * 2 + [(2, [], [])]))
    bench = spark.createDataFrame([("a", " ".join(f"w{k}" for k in range(70_000, 70_300)))], "item_id string, text string")
    for most in (2_000_000, 40):  # an item that is longer than a part is cut
        hits = sorted((r["doc_id"], sum(h["stop"] - h["start"] for h in r["f"]["hits"]), r["f"]["items"]) for r in decontam.find_windows(docs, bench, found="f", max_part_windows=most).collect())
        assert hits == [(1, 600, ["a"]), (1, 600, ["a"]), (2, 0, [])]


def test_long_repeats(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_PIECE_BYTES", 50_000)
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh ") for _ in range(LONG))
    rows = [(1, long), (2, "x" + long[1000:200_000] + "y"), (3, long[49_960:50_010])]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["spans"] == [] and bytes(got[2]["kept"]) == b"xy" and bytes(got[3]["kept"]) == b""


def test_long_conversation(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"t{k}") for k in range(3000)] + [(2, 0, "assistant", "z" * LONG)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in out.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size(chat.read_back(F.col("formatted"))).alias("n")).collect()}
    assert got[1]["loss"] == "".join(f"t{k}" for k in range(0, 3000, 3)) and got[1]["n"] == 3000 and len(got[2]["loss"]) == LONG


def test_running_sums(spark):
    for n in (1, 2, 255, 256, 257, 1000):
        got = spark.range(1).select(chat.running_sums(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("s")).first()["s"]
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]


# --- licenses: what the filters reject ------------------------------------------------


def test_license_filters_reject_and_lose_nothing(spark):
    rng = random.Random(13)
    template = " ".join(f"t{k}" for k in range(90))
    own = template.split()
    texts = []
    for _ in range(120):
        held = rng.sample(own, rng.randint(1, 90))
        texts.append(" ".join(rng.sample(held + [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60))], k=len(held))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["f"]["blocks"] for r in licenses.find_licenses(docs, found="f", phrases=(), templates=((template, "own"),)).collect()}
    half = 90
    for k, text in enumerate(texts):
        words = text.split()
        expected = [b * half for b in range(max(1, -(-len(words) // half))) if len(set(own) & set(words[b * half : (b + 2) * half])) >= 72]
        assert sorted(b["start"] for b in found[k]) == expected
    assert any(found.values())


# --- the pipeline against brute force over all stages ---------------------------------


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(14)
    model = toxicity.Model(((" moron ", 3.0),), (), (-3.0, 2.5, 0.0, 0.0))
    monkeypatch.setattr(queries, "toxicity_model", lambda *a: model)
    item = " ".join(f"item{k}" for k in range(14))
    docs = []
    for k in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(8, 120))]
        if rng.random() < 0.15:
            words.insert(2, "moron")
        if rng.random() < 0.15:
            words += item.split()[rng.randint(0, 3) :]
        if rng.random() < 0.2:
            words.insert(1, "token=abcdef99")
        docs.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            docs.append(" ".join(copy))
    docs += [None, "", docs[0], docs[0]]
    rows = [(k, t, "en", rng.choice(["src0", "src1", None]), None if t is None else len(t), 1) for k, t in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_slot int"
    for folder, own in (("full", rows), ("empty", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    kept = [r for r in rows if toxicity.matcher(model).score(toxicity.fold(r[1])) < 0.7]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, label = [shingles(r[1]) for r in kept], [r[0] for r in kept]
    for _ in kept:
        for i in range(len(kept)):
            for j in range(i):
                both = len(sets[i] | sets[j])
                if not both or len(sets[i] & sets[j]) / both >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    kept = [r for r, c in zip(kept, label, strict=True) if r[0] == c]
    windows = {tuple(item.split()[i : i + 10]) for i in range(5)}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def hit(text):
        words = word.findall((text or "").lower())
        return any(tuple(words[i : i + 10]) in windows for i in range(len(words) - 9))

    kept = [r for r in kept if not hit(r[1])]
    expected = {r[0]: None if r[1] is None else r[1].replace("token=abcdef99", "[assign]") for r in kept}
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {r["doc_id"]: r["text"] for r in out} == expected and len(out) == len(expected) < len(rows) - 20
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)
    assert all(r["mix__release"] <= r["mix__slot"] < r["mix__deadline"] for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
