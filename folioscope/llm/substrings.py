"""Removal of repeated byte strings by prefix-free parsing.

Every byte that is covered by a string of ``window`` bytes which also starts in a
document with a smaller id is removed. Strings never cross documents and are
judged on the input.

Parsing: a rolling hash of ``gram`` bytes triggers where it is the smallest of a
window, so that every window holds the trigger that its own content determines.
The windows that share a trigger form a phrase (phrases overlap by window - 1
bytes, each window lies in exactly one). Equal windows lie in phrases with equal
triggers, at equal distances. So the corpus is compared as a dictionary of phrases:

1. Phrases meet by trigger. Of equal phrases only the smallest document's goes on;
   all windows of the others are covered.
2. Phrases that differ but agree in the 17 bytes on one side of the trigger may
   share some windows; only those windows are hashed one by one, and the smallest
   document is found for each.

Both steps first combine what one task holds, so a passage that is in a third of
all documents reaches a group once per task. Data are moved as packed, compressed
arrays; the text itself is moved twice, to meet the requests of step 2 and the
results. The numbers of groups follow from the size of the text.

Windows are compared by 64 bits or more of their hashes, not by position in one
global suffix order: sorting all suffixes of the dictionary would move each byte
many times over.

Long texts are parsed and hashed in pieces of 1 MB, so memory doesn't follow their
length.

Defined results: null and empty texts have no bytes; a document shorter than the
window loses nothing; rows that repeat an id don't remove each other's text; rows
with a null id have no smaller or larger ones and lose nothing; identical rows get
identical results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut_lineage, release, tidy

WINDOW = 50
GRAM = 16
#: Bytes of text for one group of phrases, and for one group of documents.
GROUP_BYTES = 12 << 20
DOCUMENT_BYTES = 8 << 20
_PIECE_BYTES = 1 << 20
_FLUSH_PHRASES = 600_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: What is told of windows: they begin at start, start + 1, ... (n of them).
RUN = np.dtype([("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("n", "<u4")])
PHRASE = np.dtype([*RUN.descr, ("trigger", "<u8"), ("phrase", "<u4"), ("left", "<u2"), ("right", "<u2"), ("at", "<u4")])
POINT = np.dtype([("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("hash", "<u8")])
_COVER, _REQUEST = 0, 1


def pack(rows: np.ndarray) -> bytes:
    """Columns one after another, by document and start: documents as a list, starts
    as differences, triggers in six bytes, small numbers in one."""
    docs, number = np.unique(rows[["doc", "text"]], return_inverse=True)
    order = np.lexsort((rows["start"], number))
    rows, number = rows[order], number[order]
    columns = {name: np.ascontiguousarray(rows[name]) for name in rows.dtype.names if name not in ("doc", "text", "trigger")}
    columns["start"] = np.diff(columns["start"], prepend=np.uint32(0))
    if "trigger" in rows.dtype.names:
        columns["trigger"] = ((rows["trigger"] >> np.uint64(32)).astype(np.uint16), rows["trigger"].astype(np.uint32))
    for name in ("n", "at"):
        if name in columns and (not len(rows) or columns[name].max() < 256):
            columns[name] = columns[name].astype(np.uint8)
    step = np.diff(number, prepend=0)
    step = step.astype(np.uint8 if not len(step) or step.max() < 256 else np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((docs["doc"].copy(), docs["text"].copy(), step, columns), 5))


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    doc, text, step, columns = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    number = np.cumsum(step, dtype=np.int64)
    rows = np.empty(len(number), dtype)
    rows["doc"], rows["text"] = doc[number], text[number]
    columns["start"] = np.cumsum(columns["start"], dtype=np.uint32)
    if "trigger" in columns:
        high, low = columns["trigger"]
        columns["trigger"] = high.astype(np.uint64) << np.uint64(32) | low
    for name, values in columns.items():
        rows[name] = values
    return rows


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of a piece of text, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, np.uint64(_MULTIPLIER))
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        inverse = np.full(n + 1, np.uint64(pow(_MULTIPLIER, -1, 1 << 64)))
        inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.powers[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])


def parse(doc: np.ndarray, text: np.ndarray, values: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The phrases of some documents, one PHRASE row each."""
    sizes = np.array([len(v) for v in values], np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    if len(data) < window:
        return np.empty(0, PHRASE)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(values)), sizes)
    hashes = Hashes(data)
    grams = np.arange(len(data) - gram + 1)
    # the smallest hash wins, of equal ones the first
    order = (hashes.of(grams, grams + gram) & ~np.uint64(0xFFFFFFF)) | grams.astype(np.uint64)
    width, span = window - gram + 1, 1
    while span < width:
        step = min(span, width - span)
        order = np.minimum(order[: len(order) - step], order[step:])
        span += step
    starts = np.arange(len(order))
    inside = starts + window <= ends[owner[: len(order)]]
    starts, trigger = starts[inside], (order[inside] & np.uint64(0xFFFFFFF)).astype(np.int64)
    if not len(starts):
        return np.empty(0, PHRASE)
    first = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (owner[starts[1:]] != owner[starts[:-1]]))))
    n = np.diff(np.concatenate((first, [len(starts)])))
    lo, at = starts[first], trigger[first]
    hi, own = lo + n - 1, owner[lo]
    out = np.empty(len(lo), PHRASE)
    out["doc"], out["text"], out["start"], out["n"] = doc[own], text[own], lo - (ends - sizes)[own], n
    out["trigger"] = hashes.of(at, at + gram) >> np.uint64(16)
    out["phrase"] = hashes.of(lo, hi + window).astype(np.uint32)
    side = (window - gram) // 2
    left, right = lo <= at - side, hi + window >= at + gram + side
    out["left"] = np.where(left, hashes.of(np.maximum(at - side, 0), at) % np.uint64(65_535) + np.uint64(1), 0)
    stop = np.minimum(at + gram + side, len(data))
    out["right"] = np.where(right, hashes.of(at + gram, stop) % np.uint64(65_535) + np.uint64(1), 0)
    out["at"] = at - lo
    return out


def _ordered(rows: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """rows sorted by names, then document; where each group of equal names begins."""
    rows = rows[np.lexsort([rows["doc"], *[rows[name] for name in reversed(names)]])]
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([rows[name][1:] != rows[name][:-1] for name in names]) if len(rows) else True
    return rows, np.flatnonzero(new)


def _split_equal(rows: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each group's smallest document, and all others."""
    rows, first = _ordered(rows, *names)
    if not len(rows):
        return rows, rows
    least = np.repeat(rows["doc"][first], np.diff(np.concatenate((first, [len(rows)]))))
    return rows[rows["doc"] == least], rows[rows["doc"] > least]


_SAME = ("trigger", "left", "right", "phrase", "n", "at")


def _requests(rows: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Windows of phrases that another phrase with their trigger may share in part."""
    side = (window - gram) // 2
    found = []
    for name in ("left", "right"):
        own = rows[rows[name] > 0]
        own, first = _ordered(own, "trigger", name, "phrase", "n", "at")
        if not len(own):
            continue
        kind = np.zeros(len(own), np.int64)
        kind[first] = 1
        kind = np.cumsum(kind)
        group = np.ones(len(own), bool)
        group[1:] = (own["trigger"][1:] != own["trigger"][:-1]) | (own[name][1:] != own[name][:-1])
        begin = np.flatnonzero(group)
        size = np.diff(np.concatenate((begin, [len(own)])))
        several = np.repeat(kind[begin] != kind[begin + size - 1], size)
        own = own[several]
        runs = np.empty(len(own), RUN)
        for field in RUN.names:
            runs[field] = own[field]
        middle = own["start"].astype(np.int64) + own["at"] - side  # a window that begins here has side bytes before the trigger
        lo, hi = own["start"].astype(np.int64), own["start"].astype(np.int64) + own["n"]
        lo, hi = (lo, np.minimum(hi, middle + 1)) if name == "left" else (np.maximum(lo, middle), hi)
        runs["start"], runs["n"] = lo, np.maximum(hi - lo, 0)
        found.append(runs[runs["n"] > 0])
    return np.unique(np.concatenate(found)) if found else np.empty(0, RUN)


def _runs(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), RUN)
    out["doc"], out["text"], out["start"] = rows["doc"], rows["text"], rows["start"]
    out["n"] = rows["n"] if "n" in rows.dtype.names else 1
    return out


def _by_target(rows: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(rows):
        return
    order = np.argsort(target, kind="stable")
    rows, target = rows[order], target[order]
    edges = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
    for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
        yield int(target[a]), rows[a:b]


def _bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    """The group of documents that each row's document is in."""
    return (_mixed(rows["doc"].astype(np.uint64) ^ (rows["text"].astype(np.uint64) << np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _batch(targets: list[int], kinds: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(targets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["target", "kind", "blob"])


_MOVED = "target int, kind int, blob binary"
_GROUPED = pa.schema({"target": pa.int32(), "kind": pa.int32(), "blob": pa.binary()})


def _sent(rows: np.ndarray, groups: int, key: np.ndarray, covers: np.ndarray, buckets: int) -> pa.RecordBatch:
    """rows by their key's group (from 0), covers by their documents' (below 0)."""
    targets, kinds, blobs = [], [], []
    for target, part in _by_target(rows, (key % np.uint64(groups)).astype(np.int64)):
        targets.append(target)
        kinds.append(_REQUEST)
        blobs.append(pack(part))
    for target, part in _by_target(covers, _bucket(covers, buckets)):
        targets.append(-1 - target)
        kinds.append(_COVER)
        blobs.append(pack(part))
    return _batch(targets, kinds, blobs)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents in pieces of about _PIECE_BYTES: ids, text hashes, texts."""
    doc, text, values, size = [], [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            value = batch.column(1)[k].as_py()
            doc.append(batch.column(0)[k].as_py())
            text.append(xxhash.xxh32_intdigest(value))
            values.append(value)
            size += len(value)
            if size >= _PIECE_BYTES:
                yield doc, text, values
                doc, text, values, size = [], [], [], 0
    if doc:
        yield doc, text, values


def _parsed(docs: DataFrame, groups: int, buckets: int, window: int, gram: int) -> DataFrame:
    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows, rest = _split_equal(np.concatenate(held), *_SAME)
            held.clear()
            return _sent(rows, groups, rows["trigger"], _runs(rest), buckets)

        for doc, text, values in _texts(batches):
            for at in range(0, max(map(len, values)), _PIECE_BYTES):
                # of a long text, the windows that begin in this piece; a phrase that is
                # cut in two meets whole ones as any phrase that shares a part
                own = [k for k, v in enumerate(values) if len(v) > at]
                rows = parse(np.array([doc[k] for k in own], np.int64), np.array([text[k] for k in own], np.uint32), [values[k][at : at + _PIECE_BYTES + window - 1] for k in own], window, gram)
                rows["start"] += np.uint32(at)
                held.append(rows)
            if sum(map(len, held)) >= _FLUSH_PHRASES:
                yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(scan, _MOVED)


def _met(moved: DataFrame, dtype: np.dtype, same: tuple[str, ...], buckets: int, window: int, gram: int) -> DataFrame:
    """Groups of phrases or windows: what is covered, and what phrases ask for.

    Rows about documents, with targets below 0, pass through.
    """

    def meet(group: pa.Table) -> pa.Table:
        target, blobs = group["target"][0].as_py(), group["blob"]
        targets, kinds, out = [], [], []
        if target < 0:
            return pa.table([pa.array([-1 - target] * len(blobs), pa.int32()), group["kind"], blobs], schema=_GROUPED)
        rows = np.concatenate([unpack(b.as_py(), dtype) for b in blobs])
        rows, rest = _split_equal(rows, *same)
        told = [(_COVER, _runs(rest))]
        if dtype == PHRASE:
            told.append((_REQUEST, _requests(rows, window, gram)))
        for kind, runs in told:
            for bucket, part in _by_target(runs, _bucket(runs, buckets)):
                targets.append(bucket)
                kinds.append(kind)
                out.append(pack(part))
        return pa.Table.from_batches([_batch(targets, kinds, out)])

    return moved.groupBy("target").applyInArrow(meet, _MOVED)


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Compressed documents by group: target, blob."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            compressor = zstandard.ZstdCompressor(level=3)
            targets = list(held)
            blobs = [compressor.compress(pickle.dumps(held[t], 5)) for t in targets]
            held.clear()
            return _batch(targets, [0] * len(targets), blobs)

        for doc, text, values in _texts(batches):
            rows = np.empty(len(doc), RUN)
            rows["doc"], rows["text"] = doc, text
            for target, row in zip(_bucket(rows, buckets).tolist(), zip(doc, text, values, strict=True), strict=True):
                held.setdefault(target, []).append(row)
                size += len(row[2])
            if size >= DOCUMENT_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.mapInArrow(scan, _MOVED)


def _documents(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    for blob in table["blob"]:
        yield from pickle.loads(zstandard.ZstdDecompressor().decompress(blob.as_py()))


def _told(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Runs by document."""
    if not table.num_rows:
        return {}
    rows = np.concatenate([unpack(b.as_py(), RUN) for b in table["blob"]])
    rows = rows[np.lexsort((rows["start"], rows["text"], rows["doc"]))]
    new = np.flatnonzero(np.concatenate(([True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["text"][1:] != rows["text"][:-1]))))
    return {(int(rows["doc"][a]), int(rows["text"][a])): rows[a:b] for a, b in zip(new, [*new[1:], len(rows)], strict=True)}


def _expanded(runs: np.ndarray) -> np.ndarray:
    """All starts of sorted runs, once each."""
    n = runs["n"].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    return np.unique(np.repeat(runs["start"].astype(np.int64) - begin, n) + np.arange(n.sum()))


def _asked(requests: DataFrame, docs: DataFrame, groups: int, buckets: int, window: int) -> DataFrame:
    """The requested windows' hashes, by group of hashes."""

    def look(asked: pa.Table, texts: pa.Table) -> pa.Table:
        told, held = _told(asked), []
        if told:
            seen = set()
            for doc, text, value in _documents(texts):
                runs = told.get((doc, text))
                if runs is None or (doc, text) in seen:
                    continue
                seen.add((doc, text))
                starts = _expanded(runs)
                rows = np.empty(len(starts), POINT)
                rows["doc"], rows["text"], rows["start"] = doc, text, starts
                piece = starts // _PIECE_BYTES
                for p in np.unique(piece):
                    at = int(p) * _PIECE_BYTES
                    hashes = Hashes(np.frombuffer(value[at : at + _PIECE_BYTES + window - 1], np.uint8))
                    rows["hash"][piece == p] = hashes.of(starts[piece == p] - at, starts[piece == p] - at + window)
                held.append(rows)
        rows, rest = _split_equal(np.concatenate(held) if held else np.empty(0, POINT), "hash")
        return pa.Table.from_batches([_sent(rows, groups, rows["hash"], _runs(rest), buckets)])

    return requests.groupBy("target").cogroup(_packed(docs, buckets).groupBy("target")).applyInArrow(look, _MOVED)


_KEPT = "doc_id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary"
_KEPT_ARROW = pa.schema({"doc_id": pa.int64(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()})), "kept": pa.binary()})


def _removed(covers: DataFrame, docs: DataFrame, buckets: int, window: int) -> DataFrame:
    def cut(covered: pa.Table, texts: pa.Table) -> pa.Table:
        told = _told(covered)
        out: list[list] = [[], [], [], []]
        for doc, text, value in _documents(texts):
            runs, spans, kept = told.get((doc, text)), [], value
            if runs is not None:
                begin = runs["start"].astype(np.int64)
                reach = np.maximum.accumulate(begin + runs["n"] + window - 1)
                first = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
                edges = np.stack((begin[first], reach[np.concatenate((first[1:], [len(reach)])) - 1]), axis=1)
                spans = [{"start": a, "stop": b} for a, b in edges.tolist()]
                stops = [0, *edges[:, 1].tolist()]
                kept = b"".join(value[a:b] for a, b in zip(stops, [*edges[:, 0].tolist(), len(value)], strict=True))
            for column, x in zip(out, (doc, len(value), spans, kept), strict=True):
                column.append(x)
        return pa.table(out, schema=_KEPT_ARROW)

    return covers.groupBy("target").cogroup(_packed(docs, buckets).groupBy("target")).applyInArrow(cut, _KEPT)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes) and kept (the rest)."""
    own = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), as_bytes(f"`{text}`").alias("text"))
    known, unknown = own.filter("doc_id is not null"), own.filter("doc_id is null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = total // GROUP_BYTES + 1, total // DOCUMENT_BYTES + 1

    phrases = _met(_parsed(known, groups, buckets, window, gram), PHRASE, _SAME, buckets, window, gram)
    phrases = cut_lineage(phrases)
    release(docs.sparkSession)
    asked = _asked(phrases.filter(F.col("kind") == _REQUEST), known, groups, buckets, window)
    windows = cut_lineage(_met(asked, POINT, ("hash",), buckets, window, gram))
    release(docs.sparkSession)
    covers = phrases.filter(F.col("kind") == _COVER).union(windows.filter(F.col("kind") == _COVER))
    found = _removed(covers, known, buckets, window)
    whole = unknown.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.col("text").alias("kept"))
    return found.union(whole)
