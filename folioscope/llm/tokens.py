"""Exact token-length histogram with suffix sums.

Documents are encoded whole with a public byte-level BPE vocabulary and counted
by encoded length; runs of white space of any length are cut where the pattern cuts
them anyhow, as its look-ahead would follow them one level a character. Suffix sums over the distinct lengths then answer totals,
quantiles and truncated totals for any context limit without the documents.

Defined results: null and empty texts have length 0 and are counted; repeated
rows count once each; an empty table gives an empty histogram; other columns are
ignored. The number of rows is at most the longest length plus one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, binary_values, cut_lineage, tidy

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Vocabularies are sent to the executors; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20
_BUCKET = 1024
#: Runs of what the pattern takes as white space, too long for its look-ahead.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(encoding, text: str) -> int:
    """Tokens of the whole text.

    Of a run of white space the pattern takes all but the last character as one piece,
    or all of it at the end of the text; that piece is merged on its own, and what
    stands before and after is cut as in the whole text."""
    n = at = 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : stop]))
        at = stop
    return n + len(encoding.encode_ordinary(text[at:]))


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        ranks = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary may have {MAX_VOCABULARY_BYTES} bytes")
    return ranks


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = DEFAULT_RANKS) -> DataFrame:
    """n_tokens, n_docs: one row per distinct encoded length."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value)
        found: dict[int, int] = {}
        for batch in batches:
            for value in binary_values(batch.column(0)):
                n = count_tokens(encoding, value.decode("utf-8", "replace"))
                found[n] = found.get(n, 0) + 1
        yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["n_tokens", "n"])

    counted = docs.select(as_bytes(text).alias("text")).mapInArrow(count, "n_tokens long, n long")
    return counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """What the histogram says for a context limit of each of its lengths.

    docs_at_least, tokens_at_least: of documents with n_tokens or more; total_docs
    and total_tokens: of all; truncated_tokens: all documents cut to n_tokens;
    quantile: share of documents with n_tokens or fewer.

    Sums run within buckets of lengths, then over the buckets' totals, so that no
    task needs more than one bucket or one row per bucket.
    """
    histogram = cut_lineage(histogram)  # it is read twice, and texts are encoded once
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / _BUCKET).alias("bucket"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = h.groupBy("bucket").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    buckets = buckets.select(
        "bucket",
        (F.sum("docs").over(after) - F.col("docs")).alias("later_docs"),
        (F.sum("tokens").over(after) - F.col("tokens")).alias("later_tokens"),
        F.sum("docs").over(everything).alias("total_docs"),
        F.sum("tokens").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = h.join(buckets, "bucket").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum(tokens).over(within) + F.col("later_tokens")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    shorter = F.col("total_tokens") - F.col("tokens_at_least")
    return rows.select(
        "*",
        (shorter + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens left of all documents when cut to limit."""
    whole = F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_tokens") * F.col("n_docs")))
    cut = F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))) * limit
    return sums.agg((F.coalesce(whole, F.lit(0)) + F.coalesce(cut, F.lit(0))).alias("truncated_tokens"))


def length_quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least that share of documents doesn't exceed."""
    return sums.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
