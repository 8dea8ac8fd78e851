"""Host-level quality rules, native: rule failures by host, shrunk, and joined back to documents.

Each document is measured once (words, symbols, repeated lines and windows) and judged by RULES.
Failures are aggregated by host; a host's failure rate is shrunk towards all hosts by a beta
prior whose two parameters come from the hosts' own rates (method of moments), so that a host of two
documents is not condemned by them. A host fails a rule if its shrunken rate, less MARGIN standard
deviations of its posterior, exceeds the rule's limit. A document is kept if it fails no rule itself
and its host fails none.

Native columns only. Everything about one text is computed inside its row, so no row leaves its task until it
is reduced to a few numbers; those are cut into the checkpoint folder and read twice. Host
verdicts join by an ordinary equi-join: the planner broadcasts them if their measured size allows and
otherwise splits a host that holds many rows (AQE skew join).

Windows are compared by a 64-bit hash within one text.

Defined cases: a null or empty text has no words and fails `short`; a null host is a host of its own;
a null id is returned as such; repeated rows count each time and get equal results; an empty table gives no rows; a text of any length
is measured whole, inside its row; a rate that ties with its limit does not exceed it; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, cut, let, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Least words; percentages of words in repeated windows, of symbols to words, of lines that repeat.
LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES = 20, 30, 20, 60
#: Share of a host's documents that may fail each rule, and standard deviations of benefit of the doubt.
HOST_LIMITS = {"short": 0.8, "repeats": 0.6, "symbols": 0.6, "dup_lines": 0.8}
MARGIN = 2.0


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window occurring at two or more places of the array, first place included."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        # (hash, place) in order puts equal windows side by side
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            last = F.size(p) - 1
            hit = F.filter(
                p,
                lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(p, i + 1)["h"] == x["h"])),
            )
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def length(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))),
                F.lit(0),
                lambda a, x: a + x,
            )

        repeats = let(let(pairs, places), length)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeats)

    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(n <= window, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def measured(documents: DataFrame, host: str) -> DataFrame:
    """doc_id, host and the numbers that the rules need, one row per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = documents.select(
        F.col("doc_id").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text")
    )

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    return base.select(
        "doc_id",
        "host",
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        symbols.cast("long").alias("n_symbols"),
    ).select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words")


def failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
    }


def host_verdicts(documents: DataFrame, rules: list[str]) -> DataFrame:
    """host, n_docs, rate_<rule> (shrunken), host_failed. Expects boolean columns fail_<rule>."""
    hosts = documents.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(f"fail_{r}").alias(f"k_{r}") for r in rules]
    )
    hosts = cut(hosts)
    # moments of the hosts' rates give the prior Beta(a, b) of each rule; one row
    moments = hosts.agg(
        F.sum("n_docs").alias("N"),
        F.count(F.lit(1)).alias("H"),
        *[(F.sum(f"k_{r}") / F.sum("n_docs")).alias(f"m_{r}") for r in rules],
        *[F.coalesce(F.var_samp(F.col(f"k_{r}") / F.col("n_docs")), F.lit(0.0)).alias(f"v_{r}") for r in rules],
        F.avg(1 / F.col("n_docs")).alias("inv"),
    ).first()
    failed, rates = F.lit(False), []
    for r in rules:
        m = min(max(moments[f"m_{r}"] or 0.0, 1e-6), 1 - 1e-6)
        between = (moments[f"v_{r}"] or 0.0) - m * (1 - m) * (moments["inv"] or 0.0)
        strength = min(max(m * (1 - m) / between - 1, 1.0), 1e4) if between > 0 else 1e4
        a, b = m * strength, (1 - m) * strength
        rate = (F.col(f"k_{r}") + a) / (F.col("n_docs") + a + b)
        sd = F.sqrt(rate * (1 - rate) / (F.col("n_docs") + a + b + 1))
        rates.append(rate.alias(f"rate_{r}"))
        failed = failed | (rate - MARGIN * sd > HOST_LIMITS[r])
    return hosts.select("host", "n_docs", *rates, failed.alias("host_failed"))


def apply_rules(documents: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: its numbers, what it fails, its host's rates and verdict, and kept."""
    rules = failures()
    docs = cut(measured(documents, host).select("*", *[c.alias(f"fail_{r}") for r, c in rules.items()]))
    verdicts = host_verdicts(docs, list(rules)).withColumnRenamed("host", "verdict_host")
    own = F.lit(False)
    for r in rules:
        own = own | F.col(f"fail_{r}")
    joined = docs.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    return joined.withColumn("base_failed", F.col("fail_short") | F.col("fail_repeats")).withColumn(
        "kept", ~own & ~F.col("host_failed")
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_failed",
    )
