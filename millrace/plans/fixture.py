"""A stream with duplicates, lateness, skew, drift and corruption, derived from the `events` table.

Everything is integer arithmetic on event_id (i) and user_id (u), so a second engine can derive the same.
machine: u % 8 of eight machines; cycle = click, purchase; defect = error; state_change = view;
operator_scan = signup; two machines' clocks are off by -75 and +45 s; version 2 from January 16, 3 from
January 24; i % 50 = 7 is late; i % 100 = 3 has 1 to 3 copies; i % 997 = 5 is corrupt in every copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.exprs import key_partition
from millrace.operators.disorder import TRUNCATIONS
from millrace.operators.parse import wire_value

AS_OF = "2024-01-31 02:00:00"
BATCH_LAG_S = 2


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def canonical(events: DataFrame, violations: bool = False) -> DataFrame:
    """One row per event: wire columns, duration_s, extra copies and flags; `violations` breaks some contracts."""
    i, u8 = F.col("event_id"), F.col("user_id") % 8
    ts = F.col("ts").cast("timestamp")
    kind = (
        F.when(F.col("event_type").isin("click", "purchase"), "cycle")
        .when(F.col("event_type") == "error", "defect")
        .when(F.col("event_type") == "view", "state_change")
        .otherwise("operator_scan")
    )
    version = F.when(ts < F.lit("2024-01-16").cast("timestamp"), 1).when(ts < F.lit("2024-01-24").cast("timestamp"), 2).otherwise(3)
    skew_s = F.when(u8 == 1, -75).when(u8 == 4, 45).otherwise(0)
    late_s = F.when(i % 50 == 7, (i * 7919) % 21600).otherwise(0)
    out = events.select(
        i.alias("i"),
        F.col("user_id").alias("u"),
        u8.alias("u8"),
        i.cast("string").alias("event_id"),
        kind.alias("event_type"),
        F.concat(F.lit("MW1-"), F.when(u8 < 4, "A").otherwise("B"), F.lit("-0"), (u8 % 4 + 1).cast("string")).alias("machine_id"),
        F.timestamp_micros(F.unix_micros(ts) + skew_s * 1_000_000).alias("event_time"),
        F.timestamp_micros(F.unix_micros(ts) + (40 + (i * 37) % 361 + late_s * 1000) * 1000).alias("publish_time"),
        version.cast("int").alias("schema_version"),
        F.round(F.col("value") * 1000).cast("long").alias("ms"),
        (i % 997 == 5).alias("is_corrupt"),
        F.when(i % 100 == 3, 1 + F.floor(i / 100) % 3).otherwise(0).cast("int").alias("duplicate_extra"),
        (i % 50 == 7).alias("is_late"),
    )
    v, text = F.col("schema_version"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    line = F.when(v >= 2, ',"line_id":""').otherwise("")
    i, u, u8 = F.col("i"), F.col("u"), F.col("u8")
    unit = text('"work_order":"WO-', u8, "-", F.floor(i / 200).cast("long"), '","sku":"SKU-', i % 4, '","unit_seq":', i)
    duration = F.when(v >= 3, text('"duration_ms":', F.col("ms"))).otherwise(text('"duration_s":', F.col("ms") / 1000.0))
    badge = text(F.when(v >= 2, ',"operator_badge":"OP-').otherwise(',"operator":"OP-'), u, '"')
    if violations:
        badge = F.when(i % 500 == 9, F.lit("")).otherwise(badge)
    payload = (
        F.when(F.col("event_type") == "cycle", text("{", unit, ",", duration, badge, line, "}"))
        .when(F.col("event_type") == "defect", text("{", unit, ',"defect_code":"D', i % 6, '","inspector":"OP-', u, '"', line, "}"))
        .when(
            F.col("event_type") == "state_change",
            text('{"from_state":"IDLE","to_state":"EXECUTE","reason":', F.when(i % 2 == 0, F.lit("null")).otherwise(text('"r', i % 5, '"')), line, "}"),
        )
        .otherwise(text('{"badge_id":"OP-', u, '","action":"', F.when(i % 2 == 0, "login").otherwise("logout"), '","work_order":null', line, "}"))
    )
    return out.withColumn("payload", payload).withColumn("duration_s", F.when(F.col("event_type") == "cycle", F.col("ms") / 1000.0))


def published(events: DataFrame) -> DataFrame:
    """One row per message: copies with later publish times, the topic's partition and offset."""
    copies = events.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("duplicate_extra"))))
    lag_ms = F.when(F.col("c") > 0, 5 + 300 * F.col("c")).otherwise(0)
    return (
        copies.withColumn("publish_time", F.timestamp_micros(F.unix_micros("publish_time") + lag_ms * 1000))
        .withColumn("kafka_partition", key_partition("machine_id"))
        # rising in each partition and unique; no partition has to be gathered to count it
        .withColumn("kafka_offset", F.col("i") * 4 + F.col("c"))
        .withColumn("ingest_ts", F.timestamp_micros(F.unix_micros("publish_time") + BATCH_LAG_S * 1_000_000))
    )


def bronze(events: DataFrame) -> DataFrame:
    return (
        published(events)
        .where("not is_corrupt")
        .select(
            "event_id",
            "event_type",
            "machine_id",
            "event_time",
            "publish_time",
            "schema_version",
            "payload",
            "ingest_ts",
            "kafka_partition",
            "kafka_offset",
            F.date_format("ingest_ts", "yyyy-MM-dd").alias("dt"),
            F.date_format("ingest_ts", "HH").alias("hr"),
        )
    )


def messages(events: DataFrame) -> DataFrame:
    """As on the topic: key, value, partition, offset; a corrupt message is one of the truncations."""
    texts = F.array(*[F.lit(t) for t in TRUNCATIONS])
    p = published(events)
    return p.select(
        F.col("machine_id").alias("key"),
        F.when(F.col("is_corrupt"), F.get(texts, (F.col("i") % len(TRUNCATIONS)).cast("int"))).otherwise(wire_value()).alias("value"),
        F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"),
        "ingest_ts",
    )
