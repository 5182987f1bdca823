"""Cross-reference graph: edges, orphans, broken references, hubs, cycles, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..lineage import cut_lineage
from .components import connected_components


def edges(docs: DataFrame, known: DataFrame, pattern: str = L.DOCUMENT_ID_PATTERN, body: str = "body", id: str = "sop_id") -> DataFrame:
    """src, dst, dst_known: distinct references; known has the ids that exist."""
    rows = docs.select(F.col(id).alias("src"), F.explode(T.cross_references(F.col(body), F.col(id), pattern)).alias("dst"))
    ids = known.select(F.col(id).alias("dst"), F.lit(True).alias("k")).distinct()
    return rows.join(ids, "dst", "left").select("src", "dst", F.coalesce("k", F.lit(False)).alias("dst_known"))


def degrees(nodes: DataFrame, links: DataFrame, id: str = "sop_id") -> DataFrame:
    """id, in_degree, out_degree of every node; both directions in one aggregation."""
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias(id), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias(id), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    all_nodes = nodes.select(id, F.lit(0).alias("i"), F.lit(0).alias("o"))
    rows = all_nodes.union(ends).groupBy(id).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return rows.join(nodes.select(id).distinct(), id, "left_semi")


def orphans(nodes: DataFrame, links: DataFrame, id: str = "sop_id") -> DataFrame:
    return degrees(nodes, links, id).filter("in_degree = 0 and out_degree = 0").select(id)


def broken_references(links: DataFrame) -> DataFrame:
    """dst, citers (sorted) of references to documents that don't exist."""
    return links.filter(~F.col("dst_known")).groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("citers"))


def hubs(links: DataFrame, most: int = 5) -> DataFrame:
    """dst, in_degree of the most cited."""
    return links.groupBy("dst").agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "dst").limit(most)


def cycles(links: DataFrame) -> DataFrame:
    """nodes, length of every elementary cycle, from its smallest node.

    Paths grow by one edge a round through nodes larger than their start; a round
    is cut off with a checkpoint. Rounds end when no path is left, as a path's nodes
    are distinct; cycles can be as many as there are subsets of nodes. Only edges
    inside a strongly connected part can be on a cycle, and others are dropped first.
    """
    e = cut_lineage(links.select("src", "dst").filter("src <> dst").distinct())
    e = _on_cycles(e)
    paths = e.filter("dst > src").select(F.array("src", "dst").alias("path"))
    found: DataFrame | None = None
    while True:
        paths = cut_lineage(paths)
        if paths.isEmpty():
            break
        steps = paths.select("path", F.element_at("path", -1).alias("src"), F.element_at("path", 1).alias("first")).join(e, "src")
        closed = steps.filter(F.col("dst") == F.col("first")).select(F.col("path").alias("nodes"))
        found = closed if found is None else found.union(closed)
        paths = steps.filter((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    if found is None:
        found = paths.select(F.col("path").alias("nodes")).limit(0)
    return found.select("nodes", F.size("nodes").alias("length"))


def _on_cycles(e: DataFrame) -> DataFrame:
    """Drops edges that lead from a node without predecessor or to one without
    successor, until none is left to drop."""
    n = e.count()
    while n:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.select("src", "dst").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = cut_lineage(kept)
        m = kept.count()
        if m == n:
            break
        e, n = kept, m
    return e


def cycle_edges(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """src, dst of edges within a strongly connected component: dst reaches src.

    Reachability doubles its path length each round.
    """
    e = _on_cycles(cut_lineage(links.select("src", "dst").filter("src <> dst").distinct()))
    reach, n = e, e.count()
    for _ in range(max_rounds):
        longer = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        reach = cut_lineage(reach.union(longer).distinct())
        m = reach.count()
        if m == n:
            break
        n = m
    back = reach.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return e.join(back, ["src", "dst"], "left_semi")


def clusters(pairs: DataFrame, score: str = "cosine") -> DataFrame:
    """cluster, members (sorted), size, lowest, highest of connected pairs (a, b)."""
    label = connected_components(pairs.select("a", "b"))
    inside = pairs.join(label.select(F.col("node").alias("a"), "label"), "a").groupBy("label").agg(F.min(score).alias("lowest"), F.max(score).alias("highest"))
    members = label.groupBy("label").agg(F.array_sort(F.collect_set("node")).alias("members"))
    return members.join(inside, "label").select(F.col("label").alias("cluster"), "members", F.size("members").alias("size"), "lowest", "highest")
