"""A cleaning pipeline over documents, five stages, each written as Parquet and read again.

Language ID (rejected documents go), line dedup (later matching lines go), n-gram Jaccard join (one
document of each group stays: the one of the least id), benchmark decontamination (documents with a
benchmark passage go), byte-level BPE (counts and digests of what is left).

Defined cases, in every stage: a null doc_id is an id like any other; null and empty texts go in the first stage, as they
have no letter, and a stage called by itself keeps them; texts of any length are read whole; repeated rows get equal
decisions, and of equal texts one row stays; ties go to the least doc_id; empty tables give empty tables; other
columns pass through to the last stage, whatever their names. What each stage does in such cases stands at its function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, language, line_dedup, near_duplicates
from millrace.llm.common import checkpoint_dir, cut, fresh, rest, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject. Null texts and texts without a letter are rejected; where no row
    has a language, nothing can be told and all documents are rejected as `und`."""
    names = fresh(docs.columns, *language.NAMES)
    found = language.identify(docs, language.fit(docs), names)
    return found.where(~F.col(names[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that match an earlier line; n_chars, if there, is that of the text left."""
    (removed,) = fresh(docs.columns, "removed")
    out = line_dedup.dedup_lines(docs, removed)
    if "n_chars" in docs.columns:
        chars = F.when(F.col(removed).isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of the least doc_id (null ids last). Rows of one id with other
    texts are documents of their own; null and empty texts link with nothing and stay."""
    rest(spark)
    return near_duplicates.one_of_each_group(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts are clean, rows of one id are judged each by its text."""
    rest(spark)
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document left, once for each row; a null text counts as empty."""
    import public_tokenizers

    rest(spark)
    # evaluated here, in small batches of texts; what it gives is narrow
    return cut(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates_out),
    ("benchmark decontamination", benchmark_out),
    ("byte-level BPE", bpe_round_trip),
]

#: The language model is trained, so SQL cannot express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
