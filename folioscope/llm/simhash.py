"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: texts with A-Z lower-cased, words between ASCII white space, four-word
shingles with repeats (a shorter text is one shingle); a bit is set if it is set
in over half of the shingles' XXH64 values. Two fingerprints are linked if they
differ in at most ``max_bits`` bits.

Candidates come from the pigeonring principle. With the 64 bits cut into five
segments in a ring and four differing bits at most, some segment begins a chain
in which the first l segments differ in at most 4*l/5 bits, for every l: nothing
in the first, one bit in the first two, and so on. The first two segments make
the join key (the probing side also tries each single changed bit of the second),
and the longer chains are tested before the full Hamming distance.

Work is done on distinct fingerprints, so copies cost nothing. Fingerprints that
differ within one group of four bits are linked by stars first, which joins dense
groups of near-copies in linear time; the pair search then only reports pairs
that are not yet in one component.

Defined results: null and empty texts have no words and fingerprint zero, and are
linked like any other; a null id takes part, but is never the component's id;
repeated ids are rows of their own; empty tables give no rows; other columns are
ignored by near_duplicates and kept by keep_one_each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import MAX_BROADCAST_ROWS, as_bytes, binary_values, broadcast_if_small, cut_lineage, fresh, tidy

MAX_BITS = 4
SHINGLE = 4
SEED = 42
_SEGMENTS = MAX_BITS + 1
#: Lowest bit and width of each segment.
_EDGES = [64 * k // _SEGMENTS for k in range(_SEGMENTS + 1)]
_SEGMENT = [(_EDGES[k], _EDGES[k + 1] - _EDGES[k]) for k in range(_SEGMENTS)]


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: bytes) -> int:
    """Unsigned."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def ring_near(a: Column, b: Column, max_bits: int, longs: int = 4, width: int = 16) -> Column:
    """Whether two wide fingerprints pass the pigeonring chains and then differ in at
    most max_bits bits.

    The bits are cut into a ring of segments. If max_bits differ at most, then from
    some segment on the first l segments differ in at most l parts of the budget, for
    every l; pairs without such a segment are dropped before all bits are counted.
    """
    m = longs * 64 // width
    part = F.lit((1 << width) - 1)
    counts = [F.bit_count(F.shiftrightunsigned(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))), j).bitwiseAND(part)) for k in range(longs) for j in range(0, 64, width)]

    def chained(d: Column) -> Column:
        def holds(start: Column) -> Column:
            def step(s: Column, n: Column) -> Column:
                total = s["total"] + F.get(d, (start + n - 1) % m)
                return F.struct(total.alias("total"), (s["ok"] & (total * m <= n * max_bits)).alias("ok"))

            return F.aggregate(F.sequence(F.lit(1), F.lit(m)), F.struct(F.lit(0).alias("total"), F.lit(True).alias("ok")), step, lambda s: s["ok"])

        return F.exists(F.sequence(F.lit(0), F.lit(m - 1)), holds) & (F.aggregate(d, F.lit(0), lambda x, y: x + y) <= max_bits)

    return F.get(F.transform(F.array(F.array(*counts)), chained), F.lit(0))


def fingerprint_column(text: str) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    @tidy
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.array([fingerprint(v) for v in binary_values(texts)], np.uint64)
            yield pa.array(values.view(np.int64))

    return compute.asNondeterministic()(as_bytes(text))


def _segment(fp: str, k: int) -> Column:
    low, width = _SEGMENT[k % _SEGMENTS]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _chain_key(fp: str, k: int) -> Column:
    return F.shiftleft(_segment(fp, k), 32).bitwiseOR(_segment(fp, k + 1))


def _mask(k: int, length: int) -> int:
    """The bits of length segments from k on, signed."""
    bits = 0
    for j in range(k, k + length):
        low, width = _SEGMENT[j % _SEGMENTS]
        bits |= ((1 << width) - 1) << low
    return bits - (1 << 64) if bits >> 63 else bits


def _stars(nodes: DataFrame) -> DataFrame:
    """Links among fingerprints that are equal outside one group of four bits."""
    masks = [~(0xF << (4 * j)) & (2**64 - 1) for j in range(16)]
    keys = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >> 63 else m)).alias("rest")) for j, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.j", "key.rest")
    centres = rows.groupBy("j", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("last"), F.count("*").alias("n"))
    pairs = centres.filter((F.col("n") == 2)).select("a", F.col("last").alias("b"))
    larger = rows.join(centres.filter(F.col("n") > 2).select("j", "rest", "a"), ["j", "rest"]).filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(larger)


def _flipped(k: int):
    return lambda bits: F.struct(F.lit(k).alias("k"), _chain_key("fp", k).bitwiseXOR(bits).alias("key"))


def _ring_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of groups that hold fingerprints with at most MAX_BITS differing bits."""
    index = nodes.select(
        F.col("fp").alias("a"),
        F.col("group").alias("group_a"),
        F.posexplode(F.array(*[_chain_key("fp", k) for k in range(_SEGMENTS)])).alias("k", "key"),
    )
    tries = []
    for k in range(_SEGMENTS):
        width = _SEGMENT[(k + 1) % _SEGMENTS][1]
        flips = F.array(*[F.lit(x).cast("long") for x in [0] + [1 << j for j in range(width)]])
        tries.append(F.transform(flips, _flipped(k)))
    probe = nodes.select(F.col("fp").alias("b"), F.col("group").alias("group_b"), F.explode(F.flatten(F.array(*tries))).alias("t"))
    probe = probe.select("b", "group_b", F.col("t.k").alias("k"), F.col("t.key").alias("key"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    masks = {n: F.element_at(F.array(*[F.lit(_mask(k, n)).cast("long") for k in range(_SEGMENTS)]), F.col("k") + 1) for n in (3, 4)}
    chain = F.lit(True)
    for n, mask in masks.items():
        chain &= F.bit_count(differing.bitwiseAND(mask)) <= n * MAX_BITS // _SEGMENTS
    near = chain & (F.bit_count(differing) <= MAX_BITS)
    found = index.join(probe, ["k", "key"]).filter((F.col("a") < F.col("b")) & (F.col("group_a") != F.col("group_b")) & near)
    return found.select("group_a", "group_b").distinct()


def components(fingerprints: DataFrame) -> DataFrame:
    """fp, component: for each distinct fingerprint of (id, fp) rows, the smallest
    id that is reachable by links."""
    nodes = cut_lineage(fingerprints.groupBy("fp").agg(F.min("id").alias("least")))
    stars = connected_components(_stars(nodes))
    grouped = nodes.join(stars.select(F.col("node").alias("fp"), F.col("label")), "fp", "left")
    grouped = cut_lineage(grouped.select("fp", "least", F.coalesce("label", "fp").alias("group")))
    merged = connected_components(_ring_pairs(grouped), "group_a", "group_b")
    final = grouped.join(merged.select(F.col("node").alias("group"), F.col("label").alias("final")), "group", "left")
    final = final.select("fp", "least", F.coalesce("final", "group").alias("final"))
    # only groups of several fingerprints are looked up, so that a large one meets no single task
    several = final.groupBy("final").agg(F.min("least").alias("component"), F.count("*").alias("n")).filter("n > 1")
    found = final.join(broadcast_if_small(several.select("final", "component")), "final", "left")
    return found.select("fp", F.coalesce("component", "least").alias("component"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fingerprint (signed long) and component_id of every row."""
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints = cut_lineage(own.select("id", fingerprint_column("text").alias("fp")))
    return prints.join(components(prints), "fp").select("id", F.col("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_each(docs: DataFrame, id: str = "doc_id", text: str = "text", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """docs with the rows of the smallest id of each component, columns unchanged.

    A row goes if its id isn't its component's, whatever becomes of other rows of the
    same id. Rows with a null id have no smaller id to yield to and are kept; rows that
    repeat the id and the fingerprint of a row that stays, stay.
    """
    marks = fresh(docs, "print")
    rows = docs.withColumn(marks, fingerprint_column(f"`{text}`"))
    found = near_duplicates(docs, id, text)
    gone = found.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("gone_id"), F.col("fingerprint").alias("gone_print")).distinct()
    names = {c: fresh(rows, c) for c in gone.columns}
    gone = broadcast_if_small(gone, max_rows).withColumnsRenamed(names)
    return rows.join(gone, (F.col(f"`{id}`") == F.col(names["gone_id"])) & (F.col(marks) == F.col(names["gone_print"])), "left_anti").drop(marks)
