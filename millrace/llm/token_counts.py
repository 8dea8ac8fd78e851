"""Exact length histogram: documents by encoded length, and suffix sums over it.

The histogram has one row per distinct length, so everything after it is independent of the number
of documents. Suffix sums run in two levels (blocks of lengths, then lengths within a block), so
that no single task has to order every distinct length.

Defined cases: a null or empty text has length 0; ids play no part, null or not; an empty table gives no rows; repeated rows count
each time; texts of any length are encoded whole; documents of equal length are one row, so there are no ties; other columns
are ignored, whatever their names. at_limits() orders the distinct lengths in one task: as many rows as the longest text has tokens,
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_documents
from millrace.llm.common import cut, table


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row per distinct length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    docs_over, tokens_over: documents of L tokens or more and their tokens; docs_total,
    tokens_total: of all; quantile: share of documents with at most L tokens;
    truncated_total: tokens left when every document is cut to L.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    )
    later = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    of_blocks = (
        h.groupBy("block")
        .agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
        .select(
            "block",
            (F.sum("b_docs").over(later) - F.col("b_docs")).alias("after_docs"),
            (F.sum("b_tokens").over(later) - F.col("b_tokens")).alias("after_tokens"),
            F.sum("b_docs").over(W.partitionBy()).alias("docs_total"),
            F.sum("b_tokens").over(W.partitionBy()).alias("tokens_total"),
        )
    )
    inside = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        h.join(of_blocks, "block")
        .withColumn("docs_over", F.sum("n_docs").over(inside) + F.col("after_docs"))
        .withColumn("tokens_over", F.sum("tokens").over(inside) + F.col("after_tokens"))
        .select(
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            "docs_over",
            "tokens_over",
            "docs_total",
            "tokens_total",
            ((F.col("docs_total") - F.col("docs_over") + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
            (F.col("tokens_total") - F.col("tokens_over") + F.col("context_limit") * F.col("docs_over")).alias(
                "truncated_total"
            ),
        )
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """docs_over and truncated_total for limits that need not be lengths of the histogram.

    `limits` has a column context_limit of non-negative integers; the answer for a limit lies with the next length of the table.
    """
    ordered = W.orderBy("L", F.col("is_limit").desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
    both = sums.select(
        F.col("context_limit").alias("L"), F.lit(False).alias("is_limit"), "docs_over", "tokens_over", "tokens_total"
    ).unionByName(
        limits.select(F.col("context_limit").cast("long").alias("L")).distinct().withColumn("is_limit", F.lit(True)),
        allowMissingColumns=True,
    )
    next_of = lambda c: F.first(c, ignorenulls=True).over(ordered)
    total = F.max("tokens_total").over(W.partitionBy())
    return (
        both.select(
            "L",
            "is_limit",
            F.coalesce(next_of("docs_over"), F.lit(0)).alias("docs_over"),
            F.coalesce(next_of("tokens_over"), F.lit(0)).alias("tokens_over"),
            total.alias("tokens_total"),
        )
        .where("is_limit")
        .select(
            F.col("L").alias("context_limit"),
            "docs_over",
            (F.col("tokens_total") - F.col("tokens_over") + F.col("L") * F.col("docs_over")).alias("truncated_total"),
        )
    )


def op4_token_counts(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    """Suffix sums at every length that occurs in documents."""
    import public_tokenizers

    lengths = encode_documents(
        table(spark, sf_dir, "documents"),
        rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        decode=False,
    )
    return suffix_sums(cut(length_histogram(lengths)))
