"""Benchmark decontamination by a broadcast set of normalised test n-grams.

The windows of all benchmark items (10 consecutive words; an item of fewer words
is one window) are hashed into a set that is broadcast. Each document is scanned
once: its words become numbers of the benchmark's vocabulary, rolling hashes of
its windows are looked up, and each hit is verified word by word.

The set is bounded: items are packed into parts of at most ``max_part_windows``
windows, longer items cut into several. The driver and the executors hold one part at a
time: a benchmark of more than one part is scanned in as many passes, each adding to the
documents' findings, which are cut off in between.

Defined results: null texts have no words; items without words are ignored; null
item ids count as hits but are not listed; repeated items and documents are
treated row by row; empty tables give no rows or no hits; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, as_bytes, binary_values, cut_lineage, fresh, tidy, words_of

WINDOW = 10
MAX_PART_WINDOWS = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n numbers; wraps around, so hits are verified."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MULTIPLIER + ids[k : len(ids) - n + 1 + k]
    return out


class WindowSet:
    """The windows of one part of the benchmark, looked up by hash."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        by_size: dict[int, dict[int, list[tuple[bytes, int]]]] = {}
        self.names: list[str | None] = []
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint64)
            n = min(window, len(words))
            at = by_size.setdefault(n, {})
            for start, h in enumerate(_rolling(ids, n).tolist()):
                at.setdefault(h, []).append((ids[start : start + n].tobytes(), len(self.names)))
            self.names.append(None if name is None else str(name))
        self.tables = [(n, np.array(sorted(at), np.uint64), at) for n, at in by_size.items()]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items found."""
        hit = np.zeros(len(words) + 1, np.int32)
        found: set[int] = set()
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, hashes, at in self.tables:
            if len(words) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            own = _rolling(ids, n)[starts]
            near = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for start, h in zip(starts[same := hashes[near] == own].tolist(), own[same].tolist(), strict=True):
                content = ids[start : start + n].tobytes()
                items = [item for text, item in at[h] if text == content]
                if items:
                    found.update(items)
                    hit[start] += 1
                    hit[start + n] -= 1
        return np.cumsum(hit[:-1]) > 0, found


def _parts(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[list[tuple[object, bytes]]]:
    part: list[tuple[object, bytes]] = []
    size = 0
    for name, value in benchmark.select(F.col(item).alias("item"), as_bytes(text).alias("text")).toLocalIterator():
        words = words_of(bytes(value))
        for at in range(0, max(1, len(words) - window + 1), most):
            piece = words[at : at + most + window - 1]
            n = max(1, len(piece) - window + 1)
            if part and size + n > most:
                yield part
                part, size = [], 0
            part.append((name, b" ".join(piece)))
            size += n
    if part:
        yield part


_FOUND = "struct<n_words:bigint,hits:array<struct<start:bigint,stop:bigint>>,items:array<string>>"
_FOUND_ARROW = pa.struct(
    {"n_words": pa.int64(), "hits": pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()})), "items": pa.list_(pa.string())}
)


def _scanner(part, window: int):
    """A UDF that adds one part's findings to those of the parts before."""

    @F.arrow_udf(_FOUND)
    @tidy
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        windows = WindowSet(part.value, window)
        for texts, earlier in batches:
            results = []
            for value, past in zip(binary_values(texts), earlier, strict=True):
                words = words_of(value)
                hit, found = windows.scan(words)
                items = {windows.names[i] for i in found if windows.names[i] is not None}
                if past := past.as_py():
                    items |= set(past["items"])
                    for run in past["hits"]:
                        hit[run["start"] : run["stop"]] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                runs = [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
                results.append({"n_words": len(words), "hits": runs, "items": sorted(items)})
            yield pa.array(results, _FOUND_ARROW)

    return scan.asNondeterministic()  # so that filters on findings don't run it again


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_part_windows: int = MAX_PART_WINDOWS,
    found: str = "found",
) -> DataFrame:
    """docs with one more column: n_words, hits and items of each document.

    hits: maximal runs of hit words (stop exclusive, words from 0); items: ids of
    the items with occurring windows, distinct and sorted as strings.
    """
    context = docs.sparkSession.sparkContext
    parts = _parts(benchmark, item, item_text, window, max_part_windows)
    part, rows = next(parts, []), docs.withColumn(found, F.lit(None).cast(_FOUND))
    while True:
        held = context.broadcast(part)
        rows = rows.withColumn(found, _scanner(held, window)(as_bytes(f"`{text}`"), F.col(f"`{found}`")))
        part = next(parts, None)
        if part is None:
            return rows
        rows = cut_lineage(rows)
        held.destroy()


def findings(found: Column) -> dict[str, Column]:
    """n_words, n_hit, n_items, items_sha256 and contaminated of a findings column."""
    n_hit = F.aggregate(found["hits"], F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    return {
        "n_words": found["n_words"],
        "n_hit": n_hit,
        "n_items": F.size(found["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(found["items"], ","), 256),
        "contaminated": n_hit > 0,
    }


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_share: float = 0.0, **options) -> DataFrame:
    """The documents of which at most max_share of the words are hit, unchanged.

    Documents without words (null texts, too) have none hit and stay; a share that ties
    with max_share stays; repeated rows share one fate; empty tables give no rows, an
    empty benchmark keeps all; other columns, whatever their names, stay.
    """
    name = fresh(docs, "found")
    rows = find_windows(docs, benchmark, text, found=name, **options)
    facts = findings(F.col(name))
    return rows.filter(facts["n_hit"] <= F.lit(max_share) * facts["n_words"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _without(text: str | None, runs: list[dict]) -> str | None:
    if text is None or not runs:
        return text
    raw = text.encode()
    spaced = np.frombuffer(b" " + raw.translate(WORD_TABLE) + b" ", np.uint8) == 32
    starts, stops = np.flatnonzero(spaced[:-1] & ~spaced[1:]), np.flatnonzero(~spaced[:-1] & spaced[1:])
    kept, at = [], 0
    for run in runs:
        kept.append(raw[at : starts[run["start"]]])
        at = stops[run["stop"] - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with every hit run of words cut out of their texts.

    What stands between the first and the last word of a run goes with it; the
    rest, separators included, stays byte for byte. Null texts stay null; no row goes;
    repeated rows are cut alike; empty tables give no rows; other columns stay.
    """
    name = fresh(docs, "found")
    rows = find_windows(docs, benchmark, text, found=name, **options)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array((_without(t.as_py(), h.as_py()) for t, h in zip(texts, hits, strict=True)), pa.string())

    columns = [cut.asNondeterministic()(F.col(f"`{c}`").cast("string"), F.col(f"{name}.hits")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns)
