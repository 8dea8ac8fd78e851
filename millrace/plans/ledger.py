"""The completeness ledger: what the manifest expects against what gold holds, per machine and window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import date_diff

WATERMARK_HOURS = 8
TOLERANCE_S = 0.01

#: The causes that a ledger row may name.
INVENTED = "window present in gold but absent from ground truth — the pipeline invented data"
LOST = "window present in ground truth but absent from gold — the pipeline lost a window"
EVENTS = "event count differs after accounting for injected corruptions"
UNITS = "unit count differs"
DEFECTS = "defect count differs"
DURATION = "cycle duration sum differs"
CHECKSUM = "event ids differ although the counts agree"


def joined(manifest: DataFrame, agg: DataFrame) -> DataFrame:
    """Full outer join on machine and window, with a flag for each side, since USING erases the sides' keys."""
    m = manifest.select("machine_id", "window_start", F.struct(*[c for c in manifest.columns if c not in ("machine_id", "window_start")]).alias("m"))
    a = agg.select("machine_id", "window_start", F.struct(*[c for c in agg.columns if c not in ("machine_id", "window_start")]).alias("a"))
    return m.join(a, ["machine_id", "window_start"], "full_outer")


def completeness_ledger(
    manifest: DataFrame,
    agg: DataFrame,
    as_of: datetime | str | Column | None = None,
    watermark_hours: int = WATERMARK_HOURS,
    strict: bool = False,
) -> DataFrame:
    """18 columns per machine and window, status reconciled, pending or broken.

    `strict` compares id checksums where agg carries observed_checksum (with the manifest's good_checksum, or without such a
    column its checksum of all ids where none was corrupted), takes a window whose every event was corrupted
    as reconciled, and lets a fresh missing window be pending.
    """
    if as_of is None:
        now = F.current_timestamp()
    else:
        now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    zero = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0))
    expected = {
        "event": zero("m", "event_count") - zero("m", "corrupt_count"),
        "unit": zero("m", "unit_count") - zero("m", "corrupt_cycle_count"),
        "defect": zero("m", "defect_count") - zero("m", "corrupt_defect_count"),
        "duration": F.coalesce("m.cycle_duration_sum_s", F.lit(0.0)) - F.coalesce("m.corrupt_duration_sum_s", F.lit(0.0)),
    }
    observed = {
        "event": zero("a", "event_count"),
        "unit": zero("a", "unit_count"),
        "defect": zero("a", "defect_count"),
        "duration": F.coalesce("a.cycle_duration_sum_s", F.lit(0.0)),
    }
    j = joined(manifest, agg)
    compare_ids = strict and "observed_checksum" in agg.columns
    whole = F.when(F.col("m.corrupt_count") == 0, F.col("m.event_id_checksum")) if "event_id_checksum" in manifest.columns else F.lit(None)
    good = F.col("m.good_checksum") if "good_checksum" in manifest.columns else whole
    rows = j.select(
        "machine_id",
        "window_start",
        date_diff("hour", "window_start", now).alias("window_age_hours"),
        expected["event"].cast("long").alias("expected_event_count"),
        observed["event"].cast("long").alias("observed_event_count"),
        *[(observed[k] - expected[k]).cast("long").alias(f"{k}_delta") for k in ("event", "unit", "defect")],
        F.round(observed["duration"] - expected["duration"], 3).alias("duration_delta"),
        zero("m", "corrupt_count").cast("long").alias("injected_corrupt"),
        zero("m", "corrupt_cycle_count").cast("long").alias("injected_corrupt_cycles"),
        zero("m", "duplicate_extra_count").cast("long").alias("injected_duplicate_extra"),
        zero("m", "late_count").cast("long").alias("injected_late"),
        zero("a", "late_count").cast("long").alias("observed_late"),
        F.col("m").isNull().alias("missing_from_manifest"),
        F.col("a").isNull().alias("missing_from_gold"),
        (
            F.coalesce(good != F.col("a.observed_checksum"), F.lit(False)) if compare_ids else F.lit(False)
        ).alias("ids_differ"),
    )
    equal = (
        (F.col("event_delta") == 0)
        & (F.col("unit_delta") == 0)
        & (F.col("defect_delta") == 0)
        & (F.abs("duration_delta") < TOLERANCE_S)
        & ~F.col("ids_differ")
    )
    young = F.col("window_age_hours") < watermark_hours
    lost = F.col("missing_from_gold")
    if strict:
        lost = lost & (F.col("expected_event_count") > 0)
        status = F.when(F.col("missing_from_manifest"), "broken").when(equal, "reconciled").when(young, "pending")
    else:
        status = F.when(F.col("missing_from_manifest") | lost, "broken").when(equal, "reconciled").when(young, "pending")
    cause = (
        F.when(F.col("missing_from_manifest"), INVENTED)
        .when(lost, LOST)
        .when(F.col("event_delta") != 0, EVENTS)
        .when(F.col("unit_delta") != 0, UNITS)
        .when(F.col("defect_delta") != 0, DEFECTS)
        .when(F.abs("duration_delta") >= TOLERANCE_S, DURATION)
        .when(F.col("ids_differ"), CHECKSUM)
    )
    return rows.withColumn("status", status.otherwise("broken")).withColumn("root_cause", cause).drop("ids_differ")


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    sums = {
        "corrupt": "injected_corrupt",
        "duplicate_extra": "injected_duplicate_extra",
        "late": "injected_late",
        "late_observed": "observed_late",
        "expected_events": "expected_event_count",
        "observed_events": "observed_event_count",
    }
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return ledger.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_distinct("machine_id").alias("machines"),
        text(F.min("window_start")).alias("first_window"),
        text(F.max("window_start")).alias("last_window"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
    )


def per_machine(ledger: DataFrame) -> DataFrame:
    return (
        ledger.groupBy("machine_id")
        .agg(
            F.count(F.lit(1)).alias("windows"),
            *[F.count_if(F.col("status") == s).alias(s) for s in ("reconciled", "pending", "broken")],
            F.sum("observed_event_count").alias("events"),
        )
        .orderBy("machine_id")
    )


def broken_windows(ledger: DataFrame, n: int = 50) -> DataFrame:
    return (
        ledger.where("status = 'broken'")
        .orderBy("window_start", "machine_id")
        .limit(n)
        .select("machine_id", "window_start", "event_delta", "unit_delta", "defect_delta", "root_cause")
    )


def recent_windows(ledger: DataFrame, n: int = 40) -> DataFrame:
    return (
        ledger.orderBy(F.col("window_start").desc(), "machine_id")
        .limit(n)
        .select(
            "window_start",
            "machine_id",
            "status",
            "observed_event_count",
            "injected_corrupt",
            "injected_duplicate_extra",
            "injected_late",
        )
    )


def grade(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum(F.when(F.col("status") == "broken", 1).otherwise(0)), F.lit(0)).alias("broken")
    )


def reconciliation_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if((F.col("event_delta") == 0) & (F.col("unit_delta") == 0)).alias("exact"),
        F.sum("observed_event_count").alias("deduped"),
        (F.sum("expected_event_count") + F.sum("injected_corrupt")).alias("manifest_events"),
        F.sum("injected_corrupt").alias("corrupt"),
        F.sum("injected_duplicate_extra").alias("duplicate_extra"),
        F.sum("injected_late").alias("late"),
    )
