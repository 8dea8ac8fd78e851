"""Staging, silver and gold: each model is a function from DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.exprs import date_diff, duration_seconds, id_checksum, seconds_sum, window_start
from millrace.schemas import PAYLOAD

LATE_SECONDS = 60


def stg_events(bronze: DataFrame, lag_mode: str = "elapsed") -> DataFrame:
    """24 columns: three payload versions conformed to one shape. The payload is parsed once per row."""
    p = F.from_json("payload", PAYLOAD)
    b = bronze.withColumn("p", p)
    return b.select(
        "event_id",
        "event_type",
        "machine_id",
        "event_time",
        "publish_time",
        "schema_version",
        F.coalesce("p.operator", "p.operator_badge").alias("operator_badge"),
        F.col("p.line_id").alias("line_id"),
        F.col("p.work_order").alias("work_order"),
        F.col("p.sku").alias("sku"),
        F.col("p.unit_seq").cast("int").alias("unit_seq"),
        duration_seconds(F.col("p.duration_s"), F.col("p.duration_ms")).alias("duration_s"),
        F.col("p.defect_code").alias("defect_code"),
        F.col("p.from_state").alias("from_state"),
        F.col("p.to_state").alias("to_state"),
        F.col("p.reason").alias("reason"),
        F.col("p.action").alias("scan_action"),
        F.col("p.badge_id").alias("badge_id"),
        "ingest_ts",
        "kafka_partition",
        "kafka_offset",
        date_diff("second", "event_time", "publish_time", lag_mode).alias("publish_lag_s"),
        "dt",
        "hr",
    )


def first_copy(events: DataFrame) -> DataFrame:
    """One row per event_id: the earliest published, then the lowest offset (nulls last)."""
    order = W.partitionBy("event_id").orderBy(F.col("publish_time").asc_nulls_last(), F.col("kafka_offset").asc_nulls_last())
    return events.withColumn("copy_rank", F.row_number().over(order)).where("copy_rank = 1").drop("copy_rank")


def slv_events(stg: DataFrame) -> DataFrame:
    """Deduplicated, with its event-time window and a lateness flag; lateness never filters."""
    return (
        first_copy(stg)
        .drop("dt", "hr")
        .withColumn("window_start", window_start("event_time"))
        .withColumn("is_late", F.col("publish_lag_s") > LATE_SECONDS)
    )


def fct_cycles(slv: DataFrame) -> DataFrame:
    return slv.where("event_type = 'cycle'").select(
        F.col("event_id").alias("cycle_key"),
        "machine_id",
        "line_id",
        "work_order",
        "sku",
        "unit_seq",
        "duration_s",
        "operator_badge",
        "event_time",
        "window_start",
        "is_late",
        "schema_version",
    )


def fct_defects(slv: DataFrame) -> DataFrame:
    """`inspector` is what staging carries as the badge, which defects never have: null, as the contract stands."""
    return slv.where("event_type = 'defect'").select(
        F.col("event_id").alias("defect_key"),
        "machine_id",
        "work_order",
        "sku",
        "unit_seq",
        "defect_code",
        F.col("operator_badge").alias("inspector"),
        "event_time",
        "window_start",
        "is_late",
    )


def defects_with_cycles(defects: DataFrame, cycles: DataFrame) -> DataFrame:
    """Extension: each defect with the cycle of its unit, by work order and unit number."""
    c = cycles.select("work_order", "unit_seq", "cycle_key", "duration_s")
    return defects.join(c, ["work_order", "unit_seq"])


def dim_machine(slv: DataFrame) -> DataFrame:
    return slv.groupBy("machine_id").agg(
        F.max("line_id").alias("line_id"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("work_order").alias("work_order_count"),
    )


def agg_window_machine(slv: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per machine and window that has an event; empty windows are not filled in. `with_ids` adds observed_checksum, over
    the ids that landed, for a strict ledger."""
    kind = lambda t: F.count_if(F.col("event_type") == t)
    return slv.groupBy("machine_id", "window_start").agg(
        F.count(F.lit(1)).alias("event_count"),
        kind("cycle").alias("cycle_count"),
        kind("defect").alias("defect_count"),
        kind("state_change").alias("state_change_count"),
        kind("operator_scan").alias("operator_scan_count"),
        kind("cycle").alias("unit_count"),
        seconds_sum(F.when(F.col("event_type") == "cycle", F.col("duration_s"))).alias("cycle_duration_sum_s"),
        F.count_if("is_late").alias("late_count"),
        F.max("publish_lag_s").alias("max_publish_lag_s"),
        *([id_checksum("event_id").alias("observed_checksum")] if with_ids else []),
    )


def trailing_reprocess(previous: DataFrame, slv: DataFrame, since) -> DataFrame:
    """Extension: the window aggregate rebuilt only from windows that start at `since` or later."""
    kept = previous.where(F.col("window_start") < F.lit(since))
    return kept.unionByName(agg_window_machine(slv.where(F.col("window_start") >= F.lit(since))))


def machine_history(slv: DataFrame) -> DataFrame:
    """Extension: type-2 history of each machine's contract version, as half-open validity ranges."""
    by = W.partitionBy("machine_id").orderBy("event_time", "event_id")
    changed = slv.withColumn("before", F.lag("schema_version").over(by)).where("before is null or before <> schema_version")
    return changed.select(
        "machine_id",
        "schema_version",
        F.col("event_time").alias("valid_from"),
        F.lead("event_time").over(by).alias("valid_to"),
        F.lead("event_time").over(by).isNull().alias("is_current"),
    )
