"""Ground truth per machine and window, built from the canonical stream and not from what landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import id_checksum, seconds_sum, window_start


def build_manifest(events: DataFrame, with_ids: bool = False) -> DataFrame:
    """events: event_id, event_type, machine_id, event_time, duration_s, is_corrupt, duplicate_extra, is_late.

    `with_ids` adds good_checksum, over the ids that should land, for a strict ledger.
    """
    corrupt, kind = F.col("is_corrupt"), F.col("event_type")

    def count(which: Column) -> Column:
        return F.count_if(which).cast("int")

    seconds = lambda which: F.coalesce(seconds_sum(F.when(which, F.col("duration_s"))), F.lit(0.0))
    return events.groupBy(window_start("event_time").alias("window_start"), "machine_id").agg(
        F.count(F.lit(1)).cast("int").alias("event_count"),
        count(kind == "cycle").alias("cycle_count"),
        count(kind == "defect").alias("defect_count"),
        count(kind == "state_change").alias("state_change_count"),
        count(kind == "operator_scan").alias("operator_scan_count"),
        count(kind == "cycle").alias("unit_count"),
        seconds(kind == "cycle").alias("cycle_duration_sum_s"),
        id_checksum("event_id").alias("event_id_checksum"),
        count(corrupt).alias("corrupt_count"),
        F.coalesce(F.sum("duplicate_extra"), F.lit(0)).cast("int").alias("duplicate_extra_count"),
        count(F.col("is_late")).alias("late_count"),
        count(corrupt & (kind == "cycle")).alias("corrupt_cycle_count"),
        count(corrupt & (kind == "defect")).alias("corrupt_defect_count"),
        seconds(corrupt & (kind == "cycle")).alias("corrupt_duration_sum_s"),
        *([id_checksum(F.when(~corrupt, F.col("event_id"))).alias("good_checksum")] if with_ids else []),
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c).cast("long").alias(c)
    return manifest.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_distinct("machine_id").alias("machines"),
        total("event_count"),
        total("cycle_count"),
        total("defect_count"),
        total("corrupt_count"),
        total("duplicate_extra_count"),
        total("late_count"),
        F.min("window_start").alias("first_window"),
        F.max("window_start").alias("last_window"),
    )
