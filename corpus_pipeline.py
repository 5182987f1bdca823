"""The corpus pipeline: five stages, each calling one operator of folioscope.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontam, mixing, nearcopies, queries, secrets, toxicity
from folioscope.llm.common import delete, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go.

    The model is fitted on the labels outside the held-out third. Null and empty texts
    have the score of no match and stay; a score that ties with the threshold goes;
    repeated rows share one fate; without labels of both kinds, and on an empty table,
    nothing goes; other columns, whatever their names, stay as they are.
    """
    return toxicity.reject_toxic(docs, queries.toxicity_model(spark, sf_dir, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, the one with the smallest id.

    Near-copies have five-word shingles of Jaccard similarity 0.8 or more. Null and
    empty texts are copies of each other; rows with a null id stay; repeated ids are
    decided row by row; an empty table gives no rows; other columns stay as they are.
    """
    return nearcopies.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts have no words and stay, unless an item is as empty, which none
    is; repeated rows share one fate; an empty benchmark drops nothing; an empty table
    gives no rows; other columns, whatever their names, stay as they are.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows in rows that changed.

    Null and empty texts stay as they are; no row goes; repeated rows are redacted
    alike; an empty table gives no rows; other columns stay as they are.
    """
    return secrets.redact(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix of sources.

    A null source is in the class of sources without a target; null and empty texts
    count one unit; rows that tie are ordered by their text's hash; an empty table gives
    no rows; columns of the input stay as they are, and those added avoid their names.
    """
    return mixing.mix(docs, queries.TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("source_mix", mix_sources),
]

#: Fingerprints, learned weights and schedules can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder, and goes
    as soon as the next one is written. The last one stays for the caller."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    earlier = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if earlier is not None:
            delete(spark, earlier)
        earlier = path
    return docs
