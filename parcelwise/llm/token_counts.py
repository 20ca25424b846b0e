"""Token counts from an exact histogram of encoded lengths.

Every text is encoded once and counted by its length; suffix sums over the histogram then answer totals, quantiles and
truncated totals for every context limit without reading a text again. The sums are taken in two levels (blocks of
lengths, then lengths within a block), so no task holds more than BLOCK lengths or the list of blocks, which is one
task's: a row for each BLOCK of lengths up to the longest text, however many texts there are.

A null or empty text has length 0. Repeated rows count each time. An empty table gives an empty histogram. Only the
named text column is read, so other columns may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.byte_bpe import compiled
from parcelwise.llm.common import cut_lineage, map_batches, text_of, texts_str

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens of each row."""
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = compiled(content.value, pattern)
        return pa.RecordBatch.from_arrays([pa.array([len(encoder.encode_bytes(x)) // 4 for x in texts_str(batch)], pa.int64())], ["n_tokens"])

    return map_batches(docs.select(text_of(text_col).alias("text")), run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs; written once (a row for each length that occurs), so that what reads it several times doesn't encode again."""
    return cut_lineage(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    n_tokens, docs: the histogram; docs_from, tokens_from: documents and tokens of this length or more;
    tokens_kept: tokens left when every text is cut at this length; docs_upto: documents that fit whole;
    share_upto: docs_upto over all documents, so the q-quantile is the least n_tokens with share_upto >= q.
    """
    cells = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = cells.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_from = F.sum("docs").over(within) + F.col("later_docs")
    tokens_from = F.sum("tokens").over(within) + F.col("later_tokens")
    return cells.join(blocks, "block").select(
        "n_tokens",
        "docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("tokens_kept"),
        (F.col("all_docs") - docs_from + F.col("docs")).alias("docs_upto"),
        ((F.col("all_docs") - docs_from + F.col("docs")) / F.col("all_docs")).alias("share_upto"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, tokens_kept for any limits, in one aggregation of the histogram; no rows give zeros."""
    sums = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("docs"))), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("docs")), F.lit(0)).alias("tokens_kept"),
        ).alias(f"at_{limit}")
        for limit in limits
    ]
    return histogram.agg(*sums).select(F.inline(F.array(*[F.col(f"at_{limit}") for limit in limits])))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length within which that share of the documents fits whole."""
    least = [F.struct(F.lit(q).cast("double").alias("share"), F.min(F.when(F.col("share_upto") >= q, F.col("n_tokens"))).alias("n_tokens")).alias(f"q{k}") for k, q in enumerate(shares)]
    return sums.agg(*least).select(F.inline(F.array(*[F.col(f"q{k}") for k in range(len(shares))])))
