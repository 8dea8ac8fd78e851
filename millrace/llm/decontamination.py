"""Benchmark decontamination, native: a broadcast hash set of benchmark windows over document windows.

Texts lower-case A-Z and split into words. A window is ten consecutive words of an item; an item with fewer is
one window. Windows are aggregated to (hash, words) -> items and broadcast if their measured number
is within BROADCAST_WINDOWS (else joined by a shuffle, which AQE splits where a window is hot). Documents
are scanned once: a row per place and window length is generated and probed inside the same
stage; equal hashes are verified word by word. A sentinel window that matches each document once carries
its row, so that neither a second scan nor a join back is needed. Only hits and one row per
document are shuffled, by document.

Defined cases: null and empty texts have no words and are clean; an empty benchmark leaves every document clean and
an empty table gives no rows; a null id is an id like any other; a text of any length is scanned whole, and only its
windows' own words travel; rows of one id with other texts are apart, and equal rows get equal results, once each;
items that tie on a window are all named, in order; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, let, packed, small_or_not, table

WINDOW = 10
BROADCAST_WINDOWS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentinel windows, with the hashes 0, 1, ... (a true hash that equals one has another length): each document has one of
#: them, by its own hash, so that none is hot if windows are joined by a shuffle.
SENTINELS = 1024


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """h, gram, len, items: distinct windows and the sorted ids of the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(
        "size(w) > 0"
    )
    size = F.least(F.size("w"), F.lit(window))
    return (
        items.select("item_id", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
        .select("item_id", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
        .groupBy("gram", "len")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(F.xxhash64("gram").alias("h"), "gram", "len", "items")
    )


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: n_words, found = sorted array of (at, len, items), places counted from 1."""
    spark = documents.sparkSession
    grams = cut(benchmark_windows(benchmark, window))
    lengths = [r["len"] for r in grams.select("len").distinct().collect()]  # at most `window` of them
    n_grams = grams.count()
    sentinel = spark.range(SENTINELS).select(
        F.col("id").alias("h"),
        F.lit(None).cast("array<string>").alias("gram"),
        F.lit(0).alias("len"),
        F.array().cast("array<string>").alias("items"),
    )
    targets = grams.unionByName(sentinel).select(
        F.col("h").alias("t_h"), F.col("gram").alias("t_gram"), F.col("len").alias("t_len"), "items"
    )
    docs = documents.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    docs = docs.select("doc_id", "key", "w", F.size("w").cast("long").alias("n_words"))
    docs = docs.select("*", F.explode(F.array([F.lit(0)] + [F.lit(k) for k in sorted(lengths)])).alias("len"))
    # length 0 is the sentinel's: one place in every document, words or none
    places = F.when(F.col("len") == 0, F.array(F.lit(0))).when(
        F.col("n_words") >= F.col("len"), F.sequence(F.lit(1), (F.col("n_words") - F.col("len") + 1).cast("int"))
    )
    # only the window's own words go on, so that a shuffled row stays small in a long document
    probes = (
        docs.select("*", F.explode(places).alias("at"))
        .select("doc_id", "key", "n_words", "len", "at", F.slice("w", F.greatest(F.col("at"), F.lit(1)), F.col("len")).alias("gram"))
        .withColumn("h", F.when(F.col("len") == 0, F.pmod(F.xxhash64("doc_id", "key"), F.lit(SENTINELS))).otherwise(F.xxhash64("gram")))
    )
    same = (
        (F.col("h") == F.col("t_h"))
        & (F.col("len") == F.col("t_len"))
        & ((F.col("len") == 0) | (F.col("t_gram") == F.col("gram")))
    )
    matched = probes.join(small_or_not(targets, n_grams, BROADCAST_WINDOWS), same)
    # a row for each copy of a repeated row comes from the sentinel matches, which are counted
    return (
        matched.select("doc_id", "key", "n_words", "at", "len", "items")
        .groupBy("doc_id", "key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count_if(F.col("len") == 0).alias("copies"),
            F.collect_set(F.when(F.col("len") > 0, F.struct("at", "len", "items"))).alias("found"),
        )
        .select("doc_id", "key", "n_words", F.array_sort("found").alias("found"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .drop("copy")
    )


def hit_spans(found: Column) -> Column:
    """Sorted places to merged spans (first, last) of words, counted from 1."""

    def step(acc: Column, x: Column) -> Column:
        last = x["at"] + x["len"] - 1
        tail = F.get(acc, F.size(acc) - 1)
        merged = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(tail["first"].alias("first"), F.greatest(tail["last"], last).alias("last"))),
        )
        fresh = F.concat(acc, F.array(F.struct(x["at"].alias("first"), last.alias("last"))))
        return F.when((F.size(acc) > 0) & (x["at"] <= tail["last"] + 1), merged).otherwise(fresh)

    return F.aggregate(found, F.array().cast("array<struct<first:int,last:int>>"), step)


def n_hit(found: Column) -> Column:
    """Words inside any of the sorted places."""
    end = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last = x["at"] + x["len"] - 1
        fresh = F.greatest(F.lit(0), last - F.greatest(acc["last"], x["at"] - 1))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["last"], last).alias("last"))

    return F.aggregate(found, end, step, lambda acc: acc["n"])


def item_ids(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: x["items"]))))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, most_hit: float = 0.0) -> DataFrame:
    """The rows of documents whose share of hit words is at most `most_hit`; columns as given."""
    found = hits(documents, benchmark).select("doc_id", "key", "n_words", n_hit(F.col("found")).alias("n_hit"))
    bad = cut(found.where((F.col("n_hit") > 0) & (F.col("n_hit") > F.col("n_words") * most_hit)).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct())
    bad = small_or_not(bad, bad.count(), BROADCAST_WINDOWS)
    docs = packed(documents, F.col("doc_id"), F.xxhash64("text").alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key"))
    return docs.join(bad, same, "left_anti").select(*[F.col("row")[c].alias(c) for c in documents.columns])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words"),
        let(F.col("found"), lambda f: F.struct(n_hit(f).alias("n_hit"), item_ids(f).alias("ids"))).alias("r"),
    ).select(
        "doc_id",
        "n_words",
        "r.n_hit",
        F.size("r.ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("r.ids", ","), 256).alias("items_sha256"),
        (F.col("r.n_hit") > 0).alias("contaminated"),
    )
