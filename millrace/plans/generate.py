"""A scenario to a stream and its ground truth, in either mode of the injector."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from millrace.functions.exprs import duration_seconds, key_partition
from millrace.operators.disorder import inject, inject_in_sequence, injection_summary
from millrace.operators.manifest import build_manifest
from millrace.operators.parse import wire_value
from millrace.schemas import EVENT
from millrace.sources import lake
from millrace.sources.plant import DEFAULT, Plant, Scenario
from millrace.sources.simulator import simulate


#: Days of a run up to which the command line draws in sequence, on the driver, some 4,200 events a day.
SEQUENCE_DAYS = 7


def _extended(*more: StructField) -> StructType:
    return StructType([*EVENT.fields, *more])


def with_duration(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "duration_s", duration_seconds(F.get_json_object("payload", "$.duration_s"), F.get_json_object("payload", "$.duration_ms"))
    )


def message_columns() -> list:
    return [F.col("machine_id").alias("key"), wire_value().alias("value"), key_partition("machine_id").alias("partition")]


def at_scale(spark: SparkSession, scenario: Scenario, plant: Plant = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(messages with corrupt_text and slot, manifest), all in Column expressions after the simulation."""
    canonical, published = inject(simulate(spark, scenario, plant), scenario.disorder, scenario.seed)
    messages = published.select(*message_columns(), "slot", "copy", "corrupt_text")
    return messages, build_manifest(with_duration(canonical))


def write_run(spark: SparkSession, scenario: Scenario, out: str, sequence: bool = False, plant: Plant = DEFAULT) -> dict[str, int]:
    """events, manifest and injections under `out`, by either mode; what was injected."""
    if sequence:
        messages, manifest, injected = in_sequence(spark, scenario, plant)
        messages = messages.orderBy("place").coalesce(1)  # a run that the driver holds anyway
    else:
        simulated = lake.save_model(simulate(spark, scenario, plant), out, "simulated")
        canonical, sent = inject(simulated, scenario.disorder, scenario.seed)
        messages = sent.select(*message_columns(), "slot", "copy", "corrupt_text", "publish_time").orderBy("publish_time", "key", "slot", "copy")
        manifest, injected = build_manifest(with_duration(canonical)), injection_summary(canonical, sent, scenario.disorder)
    lake.write_events(messages, f"{out}/events")
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    spark.createDataFrame([(json.dumps(injected),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/injections")
    return injected


def in_sequence(spark: SparkSession, scenario: Scenario, plant: Plant = DEFAULT) -> tuple[DataFrame, DataFrame, dict]:
    """(messages, manifest, injection summary) of a small run, drawn one after another on the driver."""
    events = [tuple(r) for r in simulate(spark, scenario, plant).collect()]
    published, log, canonical = inject_in_sequence(events, scenario.disorder, scenario.seed)
    fields = EVENT.fieldNames()
    rows = [tuple(r[f] for f in fields) + (r.get("text"), i) for i, r in enumerate(published)]
    frame = spark.createDataFrame(rows, _extended(StructField("corrupt_text", StringType()), StructField("place", LongType())))
    messages = frame.select(*message_columns(), "corrupt_text", "place")
    truth = [
        tuple(r[f] for f in fields)
        + (r["event_id"] in log.corrupt, log.duplicated.get(r["event_id"], 0), r["event_id"] in log.late)
        for r in canonical
    ]
    marked = spark.createDataFrame(
        truth, _extended(
            StructField("is_corrupt", BooleanType()),
            StructField("duplicate_extra", IntegerType()),
            StructField("is_late", BooleanType()),
        )
    )
    return messages, build_manifest(with_duration(marked)), log.summary()
