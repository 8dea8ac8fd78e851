"""Windowed aggregates over a stream of events, and deduplication within the watermark.

A stream keeps the first copy that arrives, not the earliest published: silver is the batch model
over bronze. Append mode gives a window once the watermark has passed it; those withheld are what the ledger
calls pending.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from millrace.functions.exprs import seconds_sum

WATERMARK, WINDOW = "8 hours", "15 minutes"


def deduplicated(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["event_id"])


def window_counts(events: DataFrame, watermark: str | None = WATERMARK, window: str = WINDOW) -> DataFrame:
    """events(event_time, machine_id, event_type, duration_s) by window and machine; `watermark` None keeps the one it has."""
    marked = events.withWatermark("event_time", watermark) if watermark else events
    return (
        marked.groupBy(F.window("event_time", window).alias("w"), "machine_id")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(F.col("event_type") == "cycle").alias("cycle_count"),
            F.count_if(F.col("event_type") == "defect").alias("defect_count"),
            seconds_sum(F.when(F.col("event_type") == "cycle", F.col("duration_s"))).alias("cycle_duration_sum_s"),
        )
        .select("machine_id", F.col("w.start").alias("window_start"), "event_count", "cycle_count", "defect_count", "cycle_duration_sum_s")
    )


def run_to_table(frame: DataFrame, name: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Run over all that is available into a memory table; `update` keeps the last row of each window."""
    query = (
        frame.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return frame.sparkSession.table(name)


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own under the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="millrace-")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def run_to_files(frame: DataFrame, keys: list[str], root: str | None = None) -> DataFrame:
    """Run over all that is available, in update mode into files; the last batch's row of each key is its result."""
    spark = frame.sparkSession
    root = root or scratch(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (
        frame.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(StructType(list(frame.schema.fields)).add("batch_id", IntegerType())).parquet(f"{root}/out/*")
    last = W.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").select(*frame.columns)
