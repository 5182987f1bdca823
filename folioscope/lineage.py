"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster shares; a temporary one only in a local session
    that names none. On a cluster a folder of one machine would lose data, so there an
    unset folder is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


#: Rows of a side that may be broadcast (ids, names and short texts: tens of MB).
MAX_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has this many rows at most; beyond that a join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder as Parquet, by columns and compressed, and
    go on from there: for tables that are large or of which not all columns are read."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by keys if its files are fewer parts than there are cores: rows of a
    small file can be much work, which would be one task's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by keys before rows are made larger: in as many parts as shuffles have
    or four a core, whatever their bytes, as what is composed of them is much more."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
