"""Dossiers: results of many analyses brought together per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Statuses from best to worst.
STATUSES = ("n/a", "pass", "warn", "fail")


def rank(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status), F.lit(0))


def worst_status(results: DataFrame, id: str = "sop_id") -> DataFrame:
    """id, status (the worst of all modules), and how many fail, warn and pass."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("fail", "warn", "pass")]
    return results.groupBy(id).agg(F.max_by("status", rank(F.col("status"))).alias("status"), *counts)


def merged(fresh: DataFrame, saved: DataFrame, module: str = "module") -> DataFrame:
    """Fresh results in place of saved ones, by module."""
    return fresh.unionByName(saved.join(fresh.select(module).distinct(), module, "left_anti"))


def with_inherited(results: DataFrame, variants: DataFrame, id: str = "sop_id") -> DataFrame:
    """results and, for variants (variant, en) without an entry, the parent's entry if
    it says something and one of its findings names the variant."""
    have = results.select(F.col(id).alias("variant"), "module")
    parents = results.join(variants, F.col(id) == F.col("en")).filter("status <> 'n/a'")
    parents = parents.filter(F.exists("findings", lambda f: F.contains(f, F.col("variant")))).join(have, ["variant", "module"], "left_anti")
    own = [F.col("variant").alias(c) if c == id else F.col(c) for c in results.columns]
    return results.unionByName(parents.select(*own))


def findings_about(findings: DataFrame, docs: DataFrame, id: str = "sop_id") -> DataFrame:
    """id, module, finding of corpus findings that name a document, by its id or its
    id without prefix. Ids are taken out of the findings, so this is an equi-join."""
    named = findings.select("module", "finding", F.explode(F.array_distinct(T.extract_all(F.col("finding"), r"(?:SOP-)?[A-Z]{2,4}-\d{3}(?:-[A-Z]{2})?"))).alias("name"))
    full = F.when(F.col("name").startswith("SOP-"), F.col("name")).otherwise(F.concat(F.lit("SOP-"), "name"))
    return named.withColumn(id, full).join(docs.select(id), id, "left_semi").select(id, "module", "finding").distinct()
