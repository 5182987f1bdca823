"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of documents in a fixed pseudo-random order, cut into
blocks of ``block_units`` characters; a document belongs to the block in which it
begins. Block k (from 0) of a source with weight a of A is released at
floor(k*A/a) and due at ceil((k+1)*A/a), in slots of one block, and the earliest
deadline goes first. At every slot each source is then less than one block away
from its share. When a source ends, a new phase begins in which the others keep
the ratio of their weights, so every document appears exactly once.

A schedule repeats after A slots, so the driver simulates one period per phase
from block counts alone; its tables have at most (classes)^2 and classes*A rows, after
weights are divided by what divides them all, and targets for which classes*A is over
MAX_SCHEDULE are refused. Sources without a target share one class, so their number
doesn't matter.

Block numbers need running sums over whole sources. Those are made in two levels,
over ranges of the order key, as many as make a range hold about RANGE_UNITS of all
characters, so that no task holds a source, however large.

Defined results: a null source is in the shared class; null and empty texts count
one unit; rows that tie in the order (repeated ids) are ordered by their text's
hash and are interchangeable beyond that; an empty table gives no rows; columns
of the input stay as they are, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

BLOCK_UNITS = 65_536
#: Targets are a parameter, not data: a longer list is refused.
MAX_TARGETS = 1_000
#: The class of sources that have no target of their own.
SHARED = None
#: Rows of the schedule that is broadcast: a longer one is refused.
MAX_SCHEDULE = 2_000_000
#: Characters of all sources together in one range of the order key.
RANGE_UNITS = 1 << 20
_FINE_BITS = 20


@dataclass(frozen=True)
class Phase:
    """One class's part of a phase: blocks first..first+count-1 of the class, in
    slots counted from base; the class has weight of total."""

    phase: int
    klass: int
    first: int
    count: int
    base: int
    weight: int
    total: int


def period(weights: dict[int, int]) -> dict[int, list[int]]:
    """The slots of each class's blocks in one period: earliest deadline first
    among released blocks; ties go to the smaller class number."""
    total = sum(weights.values())
    slots: dict[int, list[int]] = {c: [] for c in weights}
    waiting = [(0, c, 0) for c in weights]  # release, class, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, c, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[c]), c, k))
        due, c, k = heapq.heappop(ready)
        assert due > slot, "a deadline was missed"
        slots[c].append(slot)
        if k + 1 < weights[c]:
            heapq.heappush(waiting, ((k + 1) * total // weights[c], c, k + 1))
    return slots


def schedule(blocks: dict[int, int], weights: dict[int, int]) -> tuple[list[Phase], list[tuple[int, int, int, int]]]:
    """Phases, and (phase, class, block in period, slot in period) rows."""
    left = {c: n for c, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    phases, table, base = [], [], 0
    while left:
        own = {c: weights[c] for c in left}
        total, slots = sum(own.values()), period(own)
        last = {c: (n - 1) // own[c] * total + slots[c][(n - 1) % own[c]] for c, n in left.items()}
        end = min(last.values()) + 1
        number = len({p.phase for p in phases})
        for c in list(left):
            used = end // total * own[c] + sum(s < end % total for s in slots[c])
            phases.append(Phase(number, c, done[c], used, base, own[c], total))
            table += [(number, c, k, s) for k, s in enumerate(slots[c])]
            done[c] += used
            left[c] -= used
            if not left[c]:
                del left[c]
        base += end
    return phases, table


def mix(
    docs: DataFrame,
    targets: dict[str | None, int],
    source: str = "source",
    text: str = "text",
    order: str = "doc_id",
    block_units: int = BLOCK_UNITS,
    prefix: str = "mix_",
    units: str | None = None,
    tie: str | None = None,
) -> DataFrame:
    """docs with mix_slot, mix_place, mix_block, mix_release and mix_deadline.

    targets: whole-number weights by source; SHARED (None) is the weight of all
    other sources together (default 1). Sort by mix_slot, mix_place for the mix;
    mix_place is where a document begins in its block. units, tie: columns with the
    characters and a hash of each text, for rows that don't carry their texts.
    """
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"at most {MAX_TARGETS} sources can have targets")
    if any(w < 1 for w in targets.values()):
        raise ValueError("weights are whole numbers of 1 or more")
    named = [s for s in targets if s is not SHARED]
    weights = {k + 1: targets[s] for k, s in enumerate(named)} | {0: targets.get(SHARED, 1)}
    part = math.gcd(*weights.values())
    weights = {c: w // part for c, w in weights.items()}
    if len(weights) * sum(weights.values()) > MAX_SCHEDULE:
        raise ValueError(f"sources times the sum of their weights may be {MAX_SCHEDULE} at most")
    length = F.length(F.col(f"`{text}`")) if units is None else F.col(f"`{units}`")
    hashed = F.xxhash64(F.col(f"`{text}`")) if tie is None else F.col(f"`{tie}`")
    number = F.create_map(*[F.lit(x) for k, s in enumerate(named) for x in (s, k + 1)]) if named else F.create_map().cast("map<string,int>")
    klass = F.coalesce(F.try_element_at(number, F.col(f"`{source}`").cast("string")), F.lit(0))
    key = F.xxhash64(F.col(f"`{order}`"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        klass.alias("klass"),
        key.alias("key"),
        F.shiftrightunsigned(key, 64 - _FINE_BITS).alias("fine"),
        F.greatest(F.lit(1), F.coalesce(length, F.lit(0))).cast("long").alias("units"),
        hashed.alias("tie"),
    )
    spark = docs.sparkSession
    fine = cut_lineage(rows.groupBy("klass", "fine").agg(F.sum("units").alias("units")))
    everything = fine.agg(F.sum("units")).first()[0] or 0
    bits = min(_FINE_BITS, max(0, math.ceil(math.log2(max(1, everything / RANGE_UNITS)))))
    coarse = F.shiftrightunsigned("fine", _FINE_BITS - bits).alias("range")
    rows = rows.select("row", "klass", "key", coarse, "units", "tie")
    sums = fine.select("klass", coarse, "units").groupBy("klass", "range").agg(F.sum("units").alias("units"))
    totals = {r["klass"]: r["units"] for r in sums.groupBy("klass").agg(F.sum("units").alias("units")).collect()}  # a row per class
    phases, table = schedule({c: -(-n // block_units) for c, n in totals.items()}, weights)

    before = Window.partitionBy("klass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("klass", "range", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("offset"))
    running = Window.partitionBy("klass", "range").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("units").over(running), F.lit(0))).join(offsets, ["klass", "range"])
    start = F.col("start") + F.col("offset")
    placed = placed.select("row", "klass", ((start - start % block_units) / block_units).cast("long").alias("block"), (start % block_units).alias("place"))

    phase_rows = spark.createDataFrame(
        [(p.phase, p.klass, p.first, p.count, p.base, p.weight, p.total) for p in phases],
        "phase int, klass int, first long, count long, base long, weight long, total long",
    )
    slot_rows = spark.createDataFrame(table, "phase int, klass int, inside long, slot long")
    within = (F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("count"))
    at = placed.join(F.broadcast(phase_rows).withColumnRenamed("klass", "klass_"), (F.col("klass") == F.col("klass_")) & within)
    k = F.col("block") - F.col("first")
    at = at.withColumn("k", k).withColumn("inside", F.col("k") % F.col("weight"))
    at = at.join(F.broadcast(slot_rows), ["phase", "klass", "inside"])

    def whole(x: Column) -> Column:
        return x.cast("long")

    results = {
        "slot": F.col("base") + whole(F.expr("k div weight")) * F.col("total") + F.col("slot"),
        "place": F.col("place"),
        "block": F.col("block"),
        "release": F.col("base") + whole(F.expr("(k * total) div weight")),
        "deadline": F.col("base") + whole(F.expr("((k + 1) * total + weight - 1) div weight")),
    }
    taken = {c.lower() for c in docs.columns}
    while any((prefix + name).lower() in taken for name in results):
        prefix += "_"
    return at.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[c.alias(prefix + name) for name, c in results.items()])
