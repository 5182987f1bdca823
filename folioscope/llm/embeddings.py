"""Embedding near-duplicates by iterative quantisation and multi-index tables.

A rotation for balanced binary codes is learned by iterative quantisation on a
bounded sample (``max_sample`` vectors, those with the smallest hashes); every
vector is then coded. Several rotations (different starts) give several 64-bit
codes; each code is cut into substrings of ``bits`` bits, and each substring is one
Hamming table. Vectors that share a bucket of any table are compared by the cosine
of the original vectors in double precision, and a pair counts in the first table
that holds it alone, so no pair counts twice.

The number of rotations follows from recall that is measured by brute force on the
sample: on its own links, and on copies of its vectors turned right to the threshold.
Rotations are doubled until each kind reaches ``LEAST_RECALL``; beside the learned,
centred codes, random rotations without centring are tried, as vectors that share a
direction fall apart when it is removed. Where no codes reach it, or they would
compare more pairs than there are, every pair is compared.

Tables hold codes and ids only. A bucket first counts the differing bits of its codes,
and just those of its vectors that have another one within ``radius`` bits go on with
their components; radius is the least one that loses none of the sample's pairs, and
it is part of the measured recall. Substrings are as wide as the number of vectors
and recall allow (``bits``, or more for over 2**21 vectors), so buckets stay small.

No pair leaves the executors: a bucket yields how many partners each vector has
and a spanning forest of its links. Buckets larger than ``block`` vectors are cut
into blocks that are compared block by block as separate groups, a few rows at a time.

Exact copies are one vector with a multiplicity. Vectors that are null, empty or
zero, or hold null or non-finite components link with nothing. Vectors of different
lengths don't link; those of another length than most of the sample are compared with
all of their length. Rows that repeat an id with other vectors are one vertex: their
links are added up. Rows with a null id link with nothing. Ties at the threshold link.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import cut_lineage, tidy

COSINE = 0.95
MAX_SAMPLE = 8_000
ROTATIONS = 6
CODE_BITS = 64
BITS = 16
BLOCK = 2_048
_FEW = 32
#: Rows of a block that are compared at a time.
_CHUNK = 256
LEAST_RECALL = 0.999
MOST_ROTATIONS = 24
_MOST_LINKS = 200_000


class Codes:
    """Learned on unit vectors: a mean, and rotations after principal components.

    Not centred, the rotations are random; without rotations all vectors share the
    one bucket of one table. radius: differing bits up to which vectors are reranked."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 15, seed: int = 7, centred: bool = True, bits: int = BITS):
        self.mean = sample.mean(axis=0) if centred else np.zeros(sample.shape[1])
        rounds = rounds if centred else 0
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        self.width = min(CODE_BITS, sample.shape[1])
        self.bits = min(bits, self.width)
        self.radius = self.width
        projected = centred @ axes[:, ::-1][:, : self.width]
        rng = np.random.default_rng(seed)
        self.maps = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.standard_normal((self.width, self.width)))[0]
            for _ in range(rounds):
                left, _, right = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
                turn = (left @ right).T
            self.maps.append(axes[:, ::-1][:, : self.width] @ turn)

    @property
    def pieces(self) -> int:
        """Tables of one rotation."""
        return self.width // self.bits if self.maps else 1

    @property
    def tables(self) -> int:
        return self.pieces * max(1, len(self.maps))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row per vector, the code of each rotation."""
        if not self.maps:
            return np.zeros((len(vectors), 1), np.uint64)
        weights = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        return np.stack([((vectors - self.mean) @ m >= 0).astype(np.uint64) @ weights for m in self.maps], axis=1)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """A row per row of codes, the substring for each table."""
        shifts = np.arange(self.pieces, dtype=np.uint64) * np.uint64(self.bits)
        mask = np.uint64((1 << self.bits) - 1)
        return ((codes[:, :, None] >> shifts) & mask).reshape(len(codes), -1).astype(np.int64)

    def first_table(self, a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
        """The first table that holds both of each pair of code rows in one bucket within
        the radius, or the number of tables. most: tables from there on aren't asked."""
        first = np.full(len(a), self.tables, np.int64)
        for t in reversed(range(self.tables if most is None else most)):
            differing = a[:, t // self.pieces] ^ b[:, t // self.pieces]
            same = (differing >> np.uint64(t % self.pieces * self.bits)) & np.uint64((1 << self.bits) - 1) == 0
            first[same & (np.bitwise_count(differing) <= self.radius)] = t
        return first

    def least_distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The fewest differing bits of each pair in a rotation with a common bucket; the
        width plus 1 without one."""
        least = np.full(len(a), self.width + 1, np.int64)
        for t in range(self.tables):
            differing = a[:, t // self.pieces] ^ b[:, t // self.pieces]
            same = (differing >> np.uint64(t % self.pieces * self.bits)) & np.uint64((1 << self.bits) - 1) == 0
            least = np.where(same, np.minimum(least, np.bitwise_count(differing)), least)
        return least


def _tests(sample: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs to find: the sample's own links (a random part of many), and copies at
    the threshold, turned in any direction and in directions between vectors."""
    rng = np.random.default_rng(11)
    n = len(sample)
    firsts, seconds = [], []
    share = -(-_MOST_LINKS * 256 // n)
    for at in range(0, n, 256):
        i, j = np.nonzero(np.triu(sample[at : at + 256] @ sample.T >= cosine, at + 1))
        if len(i) > share:
            part = rng.choice(len(i), share, replace=False)
            i, j = i[part], j[part]
        firsts.append(i + at)
        seconds.append(j)
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    tests = [(sample[i], sample[j])] if len(i) else []
    for away in (rng.standard_normal(sample.shape), sample[rng.permutation(n)] - sample[rng.permutation(n)]):
        away = away - (away * sample).sum(axis=1, keepdims=True) * sample
        length = np.linalg.norm(away, axis=1, keepdims=True)
        use = length[:, 0] > 1e-6
        turned = cosine * sample[use] + np.sqrt(1 - cosine**2) * away[use] / length[use]
        tests += [(sample[use], turned)] if use.any() else []
    return tests


def fit(sample: np.ndarray, cosine: float = COSINE, rotations: int = ROTATIONS, bits: int = BITS) -> Codes:
    """The codes with the widest substrings and the fewest rotations that find enough of
    the sample's pairs, or codes that have every pair compared."""
    tests = _tests(sample, cosine)

    def measured(codes: Codes) -> float:
        """Recall of the worst kind of pairs; sets the radius to what loses none that is met."""
        recalls, farthest = [], 0
        for a, b in tests:
            found = np.concatenate([codes.least_distance(codes.of(a[k : k + 8_192]), codes.of(b[k : k + 8_192])) for k in range(0, len(a), 8_192)])
            met = found <= codes.width
            recalls.append(met.mean())
            farthest = max(farthest, int(found[met].max(initial=0)))
        codes.radius = farthest
        return min(recalls, default=1.0)

    def compared(codes: Codes) -> float:
        """Pairs of one bucket in all tables, as a share of all pairs."""
        keys = codes.keys(codes.of(sample))
        sizes = np.concatenate([np.unique(column, return_counts=True)[1] for column in keys.T]).astype(np.float64)
        return float((sizes * (sizes - 1)).sum() / max(1, len(sample) * (len(sample) - 1)))

    for width in sorted({bits, *range(BITS, bits, 4)}, reverse=True):
        number = rotations
        while 0 < number <= MOST_ROTATIONS:
            tried = [codes for codes in (Codes(sample, number, bits=width, centred=c) for c in (True, False)) if measured(codes) >= LEAST_RECALL]
            if tried:
                best = min(tried, key=compared)
                if compared(best) < 1:
                    return best
            number *= 2
    return Codes(sample, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _usable(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _coded(codes: Codes):
    @tidy
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                found = codes.of(_unit(flat.reshape(part.num_rows, -1)))
                packed = pa.array([row.astype("<u8").tobytes() for row in found], pa.binary())
                yield pa.record_batch([part.column(0), packed], names=["node", "codes"])

    return code


def _entries(codes: Codes):
    """t, key, node, code: a row per vector and table, code in that table's rotation."""

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                n = part.num_rows
                found = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(n, -1)
                keys, tables = codes.keys(found), np.tile(np.arange(codes.tables, dtype=np.int32), n)
                own = np.repeat(np.arange(n), codes.tables)
                yield pa.record_batch(
                    [pa.array(tables), pa.array(keys.reshape(-1)), part.column(0).take(pa.array(own)), pa.array(found[own, tables // codes.pieces].view(np.int64))],
                    names=["t", "key", "node", "code"],
                )

    return deal


@tidy
def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's lists of numbers as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1_024):
            part = batch.slice(at, 1_024)
            lists = [np.asarray(v.values.to_numpy(zero_copy_only=False), "<f8").tobytes() for v in part.column(3)]
            yield pa.record_batch([*part.columns[:3], pa.array(lists, pa.binary())], names=["node", "copies", "codes", "vector"])


def _blocks(entries: DataFrame, block: int, *columns: str) -> DataFrame:
    """entries by group (a bucket, or two blocks of a large one); side is 0 for a block
    that is compared with itself, or tells the blocks of a pair apart."""
    large = entries.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    large = large.select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    entries = entries.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    entries = entries.select("t", "key", "node", *columns, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    group = F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other"))
    entries = entries.select(group.alias("group"), "t", "key", side.alias("side"), "node", *columns)
    return entries.repartition("group").sortWithinPartitions("group", "t", "key", "side")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by group."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        group = rest["group"].to_numpy()
        whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
        if whole:
            yield rest.slice(0, whole)
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield rest


def _rectangles(table: pa.Table, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i, j of one group for which near(i, j, square) holds, a bounded number
    at a time. Rows of side 0 meet all later ones of their group, others only the other
    side. near(i, j, square): of two index arrays, each with each if square."""
    names = [table[c].to_numpy() for c in ("group", "t", "key")]
    side = table["side"].to_numpy()
    n = table.num_rows
    new = np.ones(n + 1, bool)
    new[1:-1] = np.logical_or.reduce([x[1:] != x[:-1] for x in names])
    edges = np.flatnonzero(new)
    sizes = np.diff(edges)
    number = np.repeat(np.arange(len(sizes)), sizes)
    few = np.repeat(sizes <= _FEW, sizes)
    for shift in range(1, min(_FEW, n)):
        i = np.flatnonzero(few[:-shift] & (number[:-shift] == number[shift:]) & ((side[:-shift] == 0) | (side[:-shift] != side[shift:])))
        if not len(i):
            continue
        for at in range(0, len(i), _CHUNK * 256):
            part = i[at : at + _CHUNK * 256]
            hit = near(part, part + shift, False)
            yield part[hit], part[hit] + shift
    for k in np.flatnonzero(sizes > _FEW):
        rows = np.arange(edges[k], edges[k + 1])
        across = side[rows[0]] != 0
        left, right = (rows[side[rows] == 1], rows[side[rows] == 2]) if across else (rows, rows)
        for at in range(0, len(left), _CHUNK):
            i, j = left[at : at + _CHUNK], right if across else right[at:]
            if not len(j):
                continue
            hit = near(i, j, True)
            x, y = np.nonzero(hit if across else np.triu(hit, 1))
            yield i[x], j[y]


def _close(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """t, key, node of entries whose code has another one within radius in its bucket."""
    for table in _whole_groups(batches):
        code = table["code"].to_numpy().view(np.uint64)
        flagged = np.zeros(table.num_rows, bool)

        def near(i: np.ndarray, j: np.ndarray, square: bool, code: np.ndarray = code) -> np.ndarray:
            return np.bitwise_count(code[i][:, None] ^ code[j] if square else code[i] ^ code[j]) <= radius

        for i, j in _rectangles(table, near):
            flagged[i] = flagged[j] = True
        found = table.filter(pa.array(flagged)).select(["t", "key", "node"]).combine_chunks()
        yield from found.to_batches()


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) of the components of links i-j among n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _compare(batches: Iterator[pa.RecordBatch], codes: Codes, cosine: float) -> Iterator[pa.RecordBatch]:
    """Yields (node, links, other): partners counted, or a link.

    A pair counts in the first table that holds it. Vectors of fewer components than
    others of a batch are filled up with zeros, which changes no cosine; groups hold
    vectors of one length."""
    for table in _whole_groups(batches):
        n = table.num_rows
        t, copies = table["t"].to_numpy(), table["copies"].to_numpy()
        parts = [np.frombuffer(v, "<f8") for v in table["vector"].to_pylist()]
        vectors = np.zeros((n, max(map(len, parts))))
        for k, part in enumerate(parts):
            vectors[k, : len(part)] = part
        vectors = _unit(vectors)
        own = np.frombuffer(b"".join(table["codes"].to_pylist()), "<u8").reshape(n, -1)
        partners, members, labels = np.zeros(n), [], []

        def near(i: np.ndarray, j: np.ndarray, square: bool, vectors: np.ndarray = vectors) -> np.ndarray:
            return (vectors[i] @ vectors[j].T if square else np.einsum("ij,ij->i", vectors[i], vectors[j])) >= cosine

        for i, j in _rectangles(table, near):
            least = t[i]
            inside = least < codes.tables  # the table of other lengths stands alone
            first = least.astype(np.int64).copy()
            if inside.any():
                first[inside] = codes.first_table(own[i[inside]], own[j[inside]], int(least[inside].max()) + 1)
            i, j = i[first == least], j[first == least]
            if not len(i):
                continue
            partners += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            member, label = _forest(n, i, j)
            members.append(member)
            labels.append(label)
        has = np.flatnonzero(partners)
        member, label = _forest(n, np.concatenate([np.zeros(0, np.int64), *members]), np.concatenate([np.zeros(0, np.int64), *labels]))
        node = table["node"].combine_chunks()
        yield pa.record_batch(
            [
                pa.concat_arrays([node.take(pa.array(has)), node.take(pa.array(member))]),
                pa.array(np.concatenate((partners[has].astype(np.int64), np.zeros(len(member), np.int64)))),
                pa.concat_arrays([pa.nulls(len(has), pa.int64()), node.take(pa.array(label))]),
            ],
            names=["node", "links", "other"],
        )


def near_duplicates(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    cosine: float = COSINE,
    max_sample: int = MAX_SAMPLE,
    rotations: int = ROTATIONS,
    bits: int = BITS,
    block: int = BLOCK,
) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    spark = rows.sparkSession
    own = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    own = own.withColumn("vector", F.when(F.col("id").isNotNull() & _usable("vector"), F.transform("vector", lambda x: x + F.lit(0.0))))
    nodes = own.filter(F.col("vector").isNotNull()).groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = cut_lineage(nodes.select("node", "copies", "vector"))
    sample = nodes.orderBy(F.xxhash64("vector"), "node").limit(max_sample).select("vector").toPandas()["vector"].tolist()
    if not sample:
        return own.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = Counter(len(v) for v in sample).most_common(1)[0][0]
    n = nodes.count()
    bits = max(bits, min(32, (n - 1).bit_length() - 5))  # about 32 vectors a bucket
    codes = fit(_unit(np.array([v for v in sample if len(v) == width], np.float64)), cosine, rotations, min(bits, width))

    usual = nodes.filter(F.size("vector") == width).select("node", "vector")
    coded = cut_lineage(usual.mapInArrow(_coded(codes), "node long, codes binary"))
    entries = coded.mapInArrow(_entries(codes), "t int, key long, node long, code long")
    close = _blocks(entries, block, "code").mapInArrow(tidy(lambda b: _close(b, codes.radius)), "t int, key long, node long")
    close = cut_lineage(close.distinct())
    known = nodes.join(coded, "node", "left")
    others = F.size("vector") != width
    rows = close.union(nodes.filter(others).select(F.lit(codes.tables).alias("t"), F.size("vector").cast("long").alias("key"), "node"))
    packed = F.coalesce("codes", F.lit(bytes(8 * max(1, len(codes.maps)))))
    rows = rows.join(known.select("node", "copies", packed.alias("codes"), "vector").mapInArrow(_bytes_of, "node long, copies long, codes binary, vector binary"), "node")
    rows = _blocks(rows, block, "copies", "codes", "vector")
    found = cut_lineage(rows.mapInArrow(tidy(lambda b: _compare(b, codes, cosine)), "node long, links long, other long"))

    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(counts, "node", "left").join(labels, "node", "left")
    known = known.select(
        "vector",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("label", "node").alias("component"),
    )
    out = own.join(known, "vector", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
