"""Toxicity scores from a weighted lexicon.

Texts are folded (lower case; look-alike letters of other scripts and digits or
signs used for letters become plain letters), an Aho-Corasick automaton finds the
lexicon's words and word beginnings, matches inside exception phrases are
dropped, and a logistic function of the matches' weight, as a sum and for the
text's length, gives a score from 0 to 1.

The lexicon and the logistic weights are fitted on labelled rows, at most
``max_sample`` of them (those with the smallest hashes of their ids); candidates
are counted by the executors, and those that occur in enough toxic documents of the
sample, and tell enough of them, reach the driver. No other bound cuts the lexicon.

Defined results: null and empty texts have no words and get the score of no
match; labels that are null or have no document are ignored; repeated rows count
once each; without labels of both kinds every score is 0; an empty table gives no
rows; other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, tidy

THRESHOLD = 0.7
MAX_SAMPLE = 20_000
LEAST_SURPRISE = 24.0
#: Phrases that are harmless although they hold a lexicon word.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "stupid question", "circus clown")
#: Look-alikes and the letters they stand for.
_CYRILLIC = dict(zip("авсеніјкморѕтухһԁԛԝ", "abcehijkmopstyxhdqw", strict=True)) | {"н": "h", "п": "n", "г": "r", "і": "i"}
_GREEK = dict(zip("αεικνορτυχωγ", "aeiknoptuxwy", strict=True))
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": " "}
_INVISIBLE = dict.fromkeys("­​‌‍⁠﻿", "")
_FULLWIDTH = {chr(0xFF21 + k): chr(0x61 + k) for k in range(26)} | {chr(0xFF41 + k): chr(0x61 + k) for k in range(26)}
_FOLD = str.maketrans(_CYRILLIC | _GREEK | _FULLWIDTH | _INVISIBLE)
_SIGN_TABLE = str.maketrans({c: x for c, x in _SIGNS.items() if c != "|"})
#: A run of letters, digits and signs that holds a sign; what comes before the first is letters.
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[0134578@$!](?:[^\W_]|[@$!])*")
_LETTER = re.compile(r"[^\W\d_]")
_BETWEEN = re.compile(r"[\W\d_]+")
_PREFIXES = range(3, 9)


def _undisguised(run: re.Match) -> str:
    """Digits and signs as letters in a run that holds a letter; exclamation marks at
    its end stay what they are, and so do numbers and signs alone."""
    word = run[0].rstrip("!")
    return word.translate(_SIGN_TABLE) + " " if _LETTER.search(word) else run[0]


def fold(text: str | None) -> str:
    """Folded words, one space around each."""
    plain = _DISGUISED.sub(_undisguised, (text or "").lower().translate(_FOLD))
    return f" {_BETWEEN.sub(' ', plain).strip()} "


def candidates(words: list[str]) -> Counter:
    """How often each word (with a space before and behind) and each beginning of
    a word (with a space before) occurs."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        found[f" {word} "] += n
        for k in _PREFIXES:
            if len(word) >= k:
                found[f" {word[:k]}"] += n
    return found


@dataclass(frozen=True)
class Model:
    """lexicon: pattern -> weight; weights: of intercept, sum, sum for length, length."""

    lexicon: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    weights: tuple[float, ...] | None


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for pattern, weight in model.lexicon:
            self.machine.add_word(pattern, (len(pattern), weight))
        for phrase in model.exceptions:
            folded = fold(phrase)
            self.machine.add_word(folded, (len(folded), None))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()
        self.weights = None if model.weights is None else np.array(model.weights)

    def total(self, folded: str) -> float:
        """The weights of the longest match at each word."""
        if self.empty:
            return 0.0
        best: dict[int, tuple[int, float]] = {}
        harmless: set[int] = set()
        for end, (size, weight) in self.machine.iter(folded):
            start = end - size + 1
            if weight is None:
                harmless.update(range(start, end))
            elif start not in best or best[start][0] < size:
                best[start] = (size, weight)
        return sum(w for at, (_, w) in best.items() if at not in harmless)

    def features(self, folded: str) -> list[float]:
        n = folded.count(" ") - 1 if len(folded) > 2 else 0
        total = self.total(folded)
        return [1.0, math.asinh(total), total / math.sqrt(n + 10), math.log1p(n) / 5]

    def score(self, folded: str) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(folded), self.weights), -30, 30))))


@lru_cache(maxsize=4)
def matcher(model: Model) -> Matcher:
    return Matcher(model)


def _sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: int) -> DataFrame:
    """toxic, text of at most ``most`` labelled rows; the ids are few enough to broadcast."""
    chosen = labels.select(F.col(f"`{id}`").alias("id"), (F.col(f"`{label}`") == 1).alias("toxic")).dropna()
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "toxic").limit(most)
    texts = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("toxic", "text")


def _candidate_counts(sample: DataFrame) -> DataFrame:
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: dict[str, list[int]] = {}
            for toxic, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), strict=True):
                for pattern, n in candidates(fold(text).split()).items():
                    row = table.setdefault(pattern, [0, 0, 0, 0])
                    row[0 if toxic else 1] += n.bit_length()
                    row[2 if toxic else 3] += 1
            columns = list(zip(*table.values(), strict=True)) if table else [()] * 4
            yield pa.record_batch([pa.array(table.keys(), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["pattern", *names])

    names = ["k1", "k0", "d1", "d0"]  # occurrences (1, 2 to 3, 4 to 7 ... in one document count 1, 2, 3 ...) and documents, toxic and not
    counted = sample.mapInArrow(count, "pattern string, k1 long, k0 long, d1 long, d0 long")
    return counted.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in names])


def _pruned(rows: list[tuple[str, int, float]]) -> dict[str, float]:
    """pattern -> weight of (pattern, k1, weight) rows.

    Of patterns with nearly the same toxic occurrences the longest stays, as it is
    the most specific; a longer pattern with fewer stays only if it says clearly
    more than what it begins with.
    """
    count = {pattern: k1 for pattern, k1, _ in rows}
    longest: dict[str, int] = {}
    for pattern, k1, _ in rows:
        for k in range(2, len(pattern)):
            if (shorter := pattern[:k]) in count:
                longest[shorter] = max(longest.get(shorter, 0), k1)
    kept: dict[str, float] = {}
    for pattern, k1, weight in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if longest.get(pattern, 0) >= 0.9 * k1:
            continue
        shorter = [kept[p] for k in range(2, len(pattern)) if (p := pattern[:k]) in kept]
        if not shorter or weight > shorter[-1] + 0.7:
            kept[pattern] = weight
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a small ridge, the intercept left free."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-6, *np.ones(x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    exceptions: tuple[str, ...] = EXCEPTIONS,
    max_sample: int = MAX_SAMPLE,
) -> Model:
    """Learns a model from the labels that are given."""
    sample = _sample(docs, labels, id, text, label, max_sample)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model((), exceptions, None)
    odds = F.log((F.col("k1") + 0.5) / (n[True] + 1)) - F.log((F.col("k0") + 0.5) / (n[False] + 1))
    share = n[True] / (n[True] + n[False])
    surprise = F.lit(0.0)  # the log-likelihood ratio of its documents' labels against the labels' shares
    for found, part in (("d1", share), ("d0", 1 - share)):
        expected = (F.col("d1") + F.col("d0")) * part
        surprise += F.when(F.col(found) > 0, 2 * F.col(found) * F.log(F.col(found) / expected)).otherwise(0.0)
    scored = _candidate_counts(sample).filter("d1 >= 4").select("pattern", "k1", odds.alias("w"), surprise.alias("g"))
    top = scored.filter(f"w >= 2 and g >= {LEAST_SURPRISE}")
    lexicon = tuple(sorted(_pruned([(r["pattern"], r["k1"], r["w"]) for r in top.collect()]).items()))
    bare = Model(lexicon, exceptions, None)

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher(bare).features(fold(t.as_py())) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(measure, "toxic boolean, x array<double>").toPandas()  # max_sample rows at most
    weights = _logistic(np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float))
    return Model(lexicon, exceptions, tuple(weights.tolist()))


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = matcher(model)
        for texts in batches:
            yield pa.array([machine.score(fold(t.as_py())) for t in texts], pa.float64())

    return score.asNondeterministic()(text.cast("string"))


def score(docs: DataFrame, model: Model, text: str = "text", result: str = "score") -> DataFrame:
    """docs with one more column: the score."""
    return docs.withColumn(result, score_column(model, F.col(f"`{text}`")))


def reject_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, columns unchanged."""
    name = fresh(docs, "score")
    return score(docs, model, text, name).filter(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.crc32(id.cast("string").cast("binary")) % 3 == 1
