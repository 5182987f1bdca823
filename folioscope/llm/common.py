"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage, ensure_checkpoint_dir  # noqa: F401  the operators take both from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that end a word: every ASCII byte but 0-9 and a-z (after folding A-Z).
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: For bytes.translate(): A-Z become a-z, separators become a space.
WORD_TABLE = bytes.maketrans(
    UPPER.encode() + bytes(b for b in _SEPARATORS if not 0x41 <= b <= 0x5A),
    UPPER.lower().encode() + b" " * (len(_SEPARATORS) - 26),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased ASCII letters, digits and non-ASCII characters, in runs."""
    return text.translate(WORD_TABLE).split()


def fold_case(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


def as_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name made of stem that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever Spark keeps it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a side that may be broadcast (ids and hashes, so tens of MB).
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df, cut off, and marked for broadcast if it has this many rows at most; beyond
    that the join shuffles."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _trim() -> None:
    """Give memory that nothing uses back to the system, as Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(task: Callable) -> Callable:
    """A generator over Arrow batches that leaves its worker as small as it was."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            _trim()

    return run


def binary_values(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The values of a binary Arrow column, one at a time, null as empty."""
    for value in column:
        yield value.as_py() or b""
