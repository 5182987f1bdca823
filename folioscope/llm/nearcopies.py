"""Groups of near-copies: word shingles of Jaccard similarity ``similarity`` or more.

Words are those of simhash.py; a shorter text is one shingle. Shingles are compared
by their XXH64 values.

A SimHash whose bits all count all shingles differs in 15 % of its bits at similarity
0.8, so that no segment of it is sure to be equal. Here shingles are dealt to segments
by hash, and a segment is the 64-bit SimHash of its own shingles: a differing shingle
changes one segment, so a pair's fingerprints differ in at most as many segments as
their sets differ in shingles. That is the Hamming budget, and no pair is lost:

1. Sizes of a class (a power of two) have the same number of segments, chosen so that a
   set has more segments that aren't empty than its budget; a set whose partners may
   be in the next class has a fingerprint for that, too. A set that has not enough
   (small ones, rarely) offers its empty segments as well.
2. A segment that no other set has differs from any partner. Sets with more of them than
   their budget have no partner and leave.
3. A segment's level is the logarithm of the number of sets that have it, in steps that are
   divided by hash. Of each set only the segments up to a level of its own are keys, the
   lowest one that leaves more keys than the budget. So segments that very many sets have (a common line) bring no two sets
   together, as long as others do: all that either set of a pair has up to the lower of
   their levels are more than may differ, and one that both have is a key of both.
4. Pigeonring: in the ring of those segments, from some one on the first l differ in at
   most l parts of the budget, for every l. The first one is equal and is the join key;
   chains over the next 7 segments are tested as they meet, and so is a lower bound of the
   shingles that differ: the bits in which odd sketches do (each shingle flips one bit).
5. Then the full distance of the fingerprints, and then the exact similarity.

Work is done on distinct sets, so copies cost nothing. Each member of a bucket first
meets the bucket's most popular one, which joins dense groups in linear time; after
that only members of different components meet, those of the smaller component first with
what the other's members have in common.

Defined results: null and empty texts have no shingles and are copies of each other;
ties don't occur, as a component's row is the one with the smallest id; a null id takes
part, but is never the component's id; rows that repeat an id with other texts are
decided one by one; rows that repeat both id and text share one fate; empty tables give
no rows; very long texts are read whole; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from .common import as_bytes, binary_values, broadcast_if_small, cut_lineage, fresh, release, tidy
from .simhash import shingle_hashes

SIZE = 5
SIMILARITY = 0.8
#: Segments that a chain is tested on, the join key included.
CHAIN = 8
#: Steps of levels for each doubling of the number of sets, levels of a step, the highest one.
_STEPS = 4
_TIES = 256
_TOP = 128 * _TIES - 1
#: Longs of an odd sketch.
_WORDS = 8
_SPARE = 8
_SLACK = 1e-6
_PART = 65_536


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted and distinct."""
    return np.unique(shingle_hashes(text, size))


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Segments:
    """Fingerprints by segments, for sets of at least this similarity."""

    def __init__(self, similarity: float = SIMILARITY):
        self.similarity = similarity
        # shingles of a segment at which 70 % more segments than the budget aren't empty
        low, high = 0.0, 64.0
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if -math.expm1(-x) / x > 1.7 * (1 - similarity) / similarity else (low, x)
        self.load = max(low, 1 / 64)

    def budget(self, n: int) -> int:
        """Shingles in which a set of n and a similar one differ at most."""
        return int(n * (1 - self.similarity) / self.similarity + _SLACK)

    def counts(self, n: int) -> list[int]:
        """Numbers of segments that a set of n has fingerprints of; one without another
        similar set has none."""
        if not self.budget(n):
            return []
        over = 1 << n.bit_length()
        return [math.ceil(top / self.load) + _SPARE for top in ([over, 2 * over] if int(n / self.similarity + _SLACK) >= over else [over])]

    @staticmethod
    def parts(hashes: np.ndarray, m: int) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)

    def fingerprint(self, hashes: np.ndarray, m: int) -> np.ndarray:
        """The SimHash of each segment, mixed with its place; 0 if it is empty."""
        parts = self.parts(hashes, m)
        order = np.argsort(parts, kind="stable")
        hashes, parts = hashes[order], parts[order]
        places, starts = np.unique(parts, return_index=True)
        ends = np.append(starts[1:], len(parts))
        values, at = np.zeros(len(places), np.uint64), 0
        while at < len(places):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PART, "right")))
            bits = np.unpackbits(hashes[starts[at] : ends[to - 1]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.diff(np.cumsum(bits, axis=0, dtype=np.int32)[ends[at:to] - starts[at] - 1], axis=0, prepend=0)
            values[at:to] = np.packbits(2 * ones > (ends - starts)[at:to, None], axis=1).view(">u8").ravel()
            at = to
        out = np.zeros(m, np.uint64)
        out[places.astype(np.int64)] = _mixed(values ^ _mixed(places * np.uint64(0x9E3779B97F4A7C15) + np.uint64(m))) | np.uint64(1)
        return out

    def wild(self, n: int, filled: int) -> bool:
        """Whether all segments that aren't empty may differ."""
        return filled <= self.budget(n)

    def keys(self, segments: np.ndarray, n: int) -> np.ndarray:
        """A key per segment that a chain may begin with, 0 for the others."""
        if not self.wild(n, np.count_nonzero(segments)):
            return segments
        empty = _mixed(np.arange(len(segments), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(segments))) & ~np.uint64(1)
        return np.where(segments == 0, empty, segments)

    def needed(self, hashes: np.ndarray) -> list[int]:
        """For each fingerprint the keys that a set must share with others."""
        found = []
        for m in self.counts(len(hashes)):
            filled = len(np.unique(self.parts(hashes, m)))
            found.append((m if self.wild(len(hashes), filled) else filled) - self.budget(len(hashes)))
        return found


def _following(values: np.ndarray, bits: int, first: int = 1, end: int = CHAIN) -> np.ndarray:
    """The last bits of the values from first to before end after each one in the ring."""
    out = np.zeros(len(values), np.uint64)
    for j in range(first, end):
        out |= (np.roll(values, -j) & np.uint64(2**bits - 1)) << np.uint64(bits * (j - first))
    return out


_ODD = [f"odd{k}" for k in range(_WORDS)]


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits that an odd number of shingles flip; two sets differ in at least as many
    shingles as their sketches in bits."""
    at = (_mixed(hashes) >> np.uint64(32)).astype(np.int64) % (64 * _WORDS)
    return np.packbits(np.bincount(at, minlength=64 * _WORDS) % 2 == 1).view(">i8").astype(np.int64)


def chain_rows(maker: Segments, segments: np.ndarray, n: int, shared: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """keys that others have too, their own levels, the set's level, its segments up to
    there, and the segments (bytes) and levels (16 bits, in two parts) that follow each key.

    shared are the keys of this fingerprint that others have, with their levels. A set
    that offers its empty segments has the highest level.
    """
    order = np.argsort(shared, kind="stable")
    shared, levels = shared[order], levels[order]
    keys = maker.keys(segments, n)
    own = np.zeros(len(keys), np.uint64)
    if len(shared):
        at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
        own[shared[at] == keys] = levels[at][shared[at] == keys]
    filled = segments != 0
    level, budget = _TOP, maker.budget(n)
    if not maker.wild(n, np.count_nonzero(filled)):
        level = int(np.partition(own[filled], budget)[budget])
    used = (keys != 0) & (own > 0) & (own <= level)
    return keys[used], own[used], level, np.count_nonzero(own[filled] <= level), _following(segments, 8)[used], _following(own, 16, 1, 5)[used], _following(own, 16, 5)[used]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _short(digest: bytes) -> int:
    """Even."""
    return int.from_bytes(digest[:8], "big", signed=True) & ~1


def _sketches(size: int, similarity: float):
    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Segments(similarity)
        for batch in batches:
            digests, needed = [], []
            for text in binary_values(batch.column(2)):
                hashes = shingle_set(text, size)
                digests.append(_digest(hashes))
                needed.append(maker.needed(hashes))
            shorts = pa.array([_short(d) for d in digests], pa.int64())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), shorts, pa.array(needed, pa.list_(pa.int32()))], names=["id", "mark", "node", "short", "needed"]
            )

    return sketch


def _keys(size: int, similarity: float):
    """unit (short, plus the number of the fingerprint), keys."""

    @tidy
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Segments(similarity)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                units, keys = [], []
                for text in binary_values(batch.column(0).slice(at, 256)):
                    hashes = shingle_set(text, size)
                    short = _short(_digest(hashes))
                    for k, m in enumerate(maker.counts(len(hashes))):
                        own = maker.keys(maker.fingerprint(hashes, m), len(hashes))
                        units.append(short + k)
                        keys.append(own[own != 0].view(np.int64))
                yield pa.record_batch([pa.array(units, pa.int64()), _lists(keys)], names=["unit", "keys"])

    return compute


def _sets(size: int, similarity: float):
    @tidy
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Segments(similarity)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(text, size) for text in binary_values(batch.column(0).slice(at, 256))]
                digests = [_digest(s) for s in sets]
                prints = [[maker.fingerprint(s, m).view(np.int64) for m in maker.counts(len(s))] for s in sets]
                of = [_lists([p[k] if k < len(p) else np.zeros(0, np.int64) for p in prints]) for k in range(2)]
                columns = [pa.array(digests, pa.binary()), pa.array([_short(d) for d in digests], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), _lists([odd_sketch(s) for s in sets]), _lists([s.view(np.int64) for s in sets]), *of]
                yield pa.record_batch(columns, names=["node", "short", "n", "odd", "hashes", "print0", "print1"])

    return compute


def _chains(similarity: float):
    """A row per segment that a chain may begin with. popularity: how many rows the set
    meets, about."""

    @tidy
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Segments(similarity)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, info = [[np.zeros(0, np.uint64)] for _ in range(4)], []
                for short, n, odd, *lists in zip(*(c.to_pylist() for c in part.columns[:3]), *part.columns[3:], strict=True):
                    segments, shared, levels = (x.values.to_numpy(zero_copy_only=False) for x in lists)
                    keys, own, level, ring, *following = chain_rows(maker, segments.view(np.uint64), n, shared.view(np.uint64), levels.astype(np.uint64))
                    for to, values in zip(found, [keys, *following], strict=True):
                        to.append(values)
                    info.append((short, n, level, ring, int(np.exp2(own // _TIES / _STEPS).sum()), *odd, len(keys)))
                columns = np.array(info, np.int64).reshape(-1, 6 + _WORDS)
                short, n, level, ring, popularity, *odd = np.repeat(columns[:, :-1], columns[:, -1], axis=0).T
                item, following, nearer, farther = (pa.array(np.concatenate(x).view(np.int64)) for x in found)
                yield pa.record_batch(
                    [item, pa.array(short), pa.array(n.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(popularity), following, nearer, farther, *map(pa.array, odd)],
                    names=["item", "short", "n", "level", "ring", "popularity", "following", "nearer", "farther", *_ODD],
                )

    return compute


def _budget(similarity: float, na: Column, nb: Column) -> Column:
    return (na + nb) * ((1 - similarity) / (1 + similarity)) + _SLACK


def _sizes(similarity: float, na: str, nb: str) -> Column:
    return F.least(na, nb) >= F.greatest(na, nb) * similarity - _SLACK


def _chained(similarity: float) -> Column:
    """Whether rows a and b that share a key may be similar: sizes, odd sketches, and the
    first segments from the key on that either has up to the lower of their levels."""
    level = F.least("level_a", "level_b")
    ring = F.when(F.col("level_a") < F.col("level_b"), F.col("ring_a")).when(F.col("level_b") < F.col("level_a"), F.col("ring_b")).otherwise(F.greatest("ring_a", "ring_b"))
    budget = _budget(similarity, F.col("na"), F.col("nb"))
    apart = sum(F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in _ODD)
    near, seen, differing = _sizes(similarity, "na", "nb") & (apart <= budget), F.lit(1), F.lit(0)
    for j in range(CHAIN - 1):
        x, y = (F.shiftrightunsigned(f"following_{side}", 8 * j).bitwiseAND(F.lit(255)) for side in "ab")
        p, q = (F.shiftrightunsigned(f"{'nearer' if j < 4 else 'farther'}_{side}", 16 * (j % 4)).bitwiseAND(F.lit(_TOP)) for side in "ab")
        there = ((x != 0) & (p <= level)) | ((y != 0) & (q <= level))
        seen += there.cast("int")
        differing += (there & (x != y)).cast("int")
        if j in (1, 3, CHAIN - 2):
            near &= differing * ring <= seen * budget
    return near


def _facing(similarity: float) -> Column:
    """Whether row a may be similar to any of the rows of group b, by what all of them have."""
    reach = (F.col("na") >= F.col("least") * similarity - _SLACK) & (F.col("most") >= F.col("na") * similarity - _SLACK)
    apart = []
    for k in range(_WORDS):
        own, ones, zeros = F.col(f"odd{k}_a"), F.col(f"ones{k}"), F.col(f"zeros{k}")
        apart.append(F.bitwise_not(own).bitwiseAND(ones).bitwiseOR(own.bitwiseAND(zeros)))
    return reach & (sum(map(F.bit_count, apart)) <= _budget(similarity, F.col("na"), F.col("most")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b (nodes) of pairs of shorts whose fingerprints are near and whose sets reach
    the similarity."""
    def distance(a: str, b: str) -> Column:
        return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))

    def same(a: str, b: str) -> Column:
        return F.size(a) == F.size(b)

    differing = F.when(same("print0_a", "print0_b"), distance("print0_a", "print0_b")).when(same("print1_a", "print0_b"), distance("print1_a", "print0_b")).when(same("print0_a", "print1_b"), distance("print0_a", "print1_b"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    alike = both / (F.size("hashes_a") + F.size("hashes_b") - both) >= similarity

    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        """pairs with these columns of both; what pairs don't ask for isn't shuffled."""
        pairs = broadcast_if_small(pairs)
        left, right = (sets.select(F.col("short").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]).join(pairs, x) for x in "ab")
        return left.join(right, ["a", "b"])

    prints = sides(pairs, "print0", "print1", "n")
    near = prints.filter(differing <= _budget(similarity, F.col("n_a"), F.col("n_b"))).select("a", "b")
    found = sides(near, "node", "hashes").filter(alike)
    return cut_lineage(found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """id, mark (a hash of the text) and component_id of every row."""
    own = docs.select(F.col(f"`{id}`").alias("id"), as_bytes(f"`{text}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    marked = own.select("id", F.xxhash64("text").alias("mark"), "text")
    prints = cut_lineage(marked.mapInArrow(_sketches(size, similarity), f"id {kind}, mark long, node binary, short long, needed array<int>"))
    nodes = prints.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "mark")).alias("one"), F.first("short").alias("short"), F.first("needed").alias("needed"))
    nodes = cut_lineage(nodes)

    def texts_of(chosen: DataFrame) -> DataFrame:
        chosen = broadcast_if_small(chosen.select(F.col("one.id").alias("id_"), F.col("one.mark").alias("mark_")))
        return own.join(chosen, F.col("id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("mark_")), "left_semi").select("text")

    entries = texts_of(nodes.filter(F.size("needed") > 0)).mapInArrow(_keys(size, similarity), "unit long, keys array<long>")
    # windows, as a join would write all keys twice; whether others have a key doesn't show in
    # counts, as rows that repeat id and text are there more than once
    of_key = Window.partitionBy("key")
    shared = entries.select("unit", F.explode("keys").alias("key")).select("unit", "key", F.min("unit").over(of_key).alias("low"), F.max("unit").over(of_key).alias("high"), F.count("*").over(of_key).alias("met"))
    step = F.least(F.lit(_TOP // _TIES), (F.log2("met") * _STEPS).cast("int"))
    level = (step * _TIES + F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(_TIES - 1)).cast("int")).cast("smallint")
    shared = shared.filter("low <> high").groupBy("unit").agg(F.collect_list(F.struct("key", level.alias("level"))).alias("shared"))
    units = nodes.select("short", F.posexplode("needed").alias("k", "least_shared")).withColumn("unit", F.col("short") + F.col("k"))
    units = units.join(shared, "unit").filter(F.size("shared") >= F.col("least_shared"))
    units = cut_lineage(units.select("short", "k", F.col("shared.key").alias("keys"), F.col("shared.level").alias("levels")))
    del entries, shared
    release(docs.sparkSession)

    chosen = cut_lineage(nodes.join(broadcast_if_small(units.select("short").distinct()), "short", "left_semi").select("node", "one"))
    sets = texts_of(chosen).mapInArrow(_sets(size, similarity), "node binary, short long, n int, odd array<long>, hashes array<long>, print0 array<long>, print1 array<long>")
    sets = cut_lineage(sets)
    if sets.count() != chosen.count():  # rows that repeat id and text
        sets = cut_lineage(sets.groupBy("node").agg(*[F.first(c).alias(c) for c in sets.columns[1:]]))
    rows = sets.select("short", "n", "odd", F.posexplode(F.array("print0", "print1")).alias("k", "segments")).join(units, ["short", "k"])
    rows = rows.select("short", "n", "odd", "segments", "keys", F.col("levels").cast("array<int>")).mapInArrow(_chains(similarity), "item long, short long, n int, level int, ring int, popularity long, following long, nearer long, farther long, " + ", ".join(f"{c} long" for c in _ODD))
    rows = cut_lineage(rows)
    del units
    release(docs.sparkSession)
    of_set = ["n", "level", "ring", "following", "nearer", "farther", *_ODD]
    side = {x: [F.col("short").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{c}_{x}") for c in of_set[1:]]] for x in "ab"}
    centres = rows.groupBy("item").agg(F.max(F.struct("popularity", "short", *of_set)).alias("c"), F.count("*").alias("met")).filter("met > 1")
    centres = centres.select("item", "c.*").select("item", *side["b"])
    stars = rows.select("item", *side["a"]).join(centres, "item").filter((F.col("a") != F.col("b")) & _chained(similarity))
    links = _verified(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, similarity)
    del centres, stars
    release(docs.sparkSession)

    labels = connected_components(links)
    groups = sets.select("node", "short").join(labels, "node", "left").select("short", F.xxhash64(F.coalesce("label", "node")).alias("group"))
    grouped = rows.join(groups, "short")
    mixed = grouped.groupBy("item").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("item")
    grouped = cut_lineage(grouped.join(mixed, "item", "left_semi"))
    # members of one group never meet, however large it is
    held = grouped.groupBy("item", "group").agg(
        F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"),
        *[F.bit_and(x).alias(f"ones{k}") for k, x in enumerate(_ODD)], *[F.bit_and(F.bitwise_not(F.col(x))).alias(f"zeros{k}") for k, x in enumerate(_ODD)],
    )
    a = grouped.join(held.select("item", "group", "size"), ["item", "group"]).select("item", F.col("group").alias("ga"), F.col("size").alias("size_a"), *side["a"])
    b = grouped.select("item", F.col("group").alias("gb"), *side["b"])
    smaller = (F.col("size_a") < F.col("size")) | ((F.col("size_a") == F.col("size")) & (F.col("ga") < F.col("gb")))
    facing = a.join(held.withColumnRenamed("group", "gb"), "item").filter(smaller & _facing(similarity)).select(*a.columns, "gb")
    others = facing.join(b, ["item", "gb"]).filter(_chained(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.union(_verified(others, sets, similarity))

    merged = connected_components(links)
    final = nodes.select("node", "least").join(merged, "node", "left").select("node", "least", F.coalesce("label", "node").alias("final"))
    several = final.groupBy("final").agg(F.min("least").alias("smallest"), F.count("*").alias("n")).filter("n > 1")
    component = final.join(broadcast_if_small(several.select("final", "smallest")), "final", "left").select("node", F.coalesce("smallest", "least").alias("component_id"))
    return prints.select("id", "mark", "node").join(component, "node").select("id", "mark", "component_id")


def keep_one_each(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the row of the smallest id of each component, columns unchanged.

    A row goes if its id isn't its component's, so of a repeated id only the rows that
    have a representative elsewhere go. Rows with a null id have no smaller one and stay.
    """
    found = near_copies(docs, id, text, size, similarity)
    gone = found.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    gone = broadcast_if_small(gone)
    marks = fresh(docs, "mark")
    names = {c: fresh(docs, c) for c in gone.columns}
    rows = docs.withColumn(marks, F.xxhash64(as_bytes(f"`{text}`")))
    return rows.join(gone.withColumnsRenamed(names), (F.col(f"`{id}`") == F.col(names["gone_id"])) & (F.col(marks) == F.col(names["gone_mark"])), "left_anti").drop(marks)
