"""The bronze consumer: micro-batches parsed, written, then committed.

Spark records a batch's offsets before it runs and its commit after the sink returns, so a batch
whose write fails is run again with the same input and number. Its rows land under batch=<number>,
which the second run overwrites. The time of ingestion is kept with the batch, so a retry lands in the same dt and hr.
"""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import parse
from millrace.schemas import MESSAGE
from millrace.sources.lake import write_bronze, write_quarantine

BATCH_ROWS, INTERVAL = 5000, "30 seconds"
#: Of a file topic: BATCH_ROWS messages of some 300 bytes in each of six partitions, compressed about four times.
BATCH_BYTES = "2m"


def file_topic(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None, earliest: bool = True
) -> DataFrame:
    """Files bound a batch by their number or bytes, not by rows: about BATCH_ROWS a partition fit BATCH_BYTES. Without
    `earliest` only files that are written from now on are read."""
    reader = spark.readStream.schema(MESSAGE)
    for option, value in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        reader = reader.option(option, value) if value else reader
    if not earliest:
        reader = reader.option("modifiedAfter", datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    return reader.parquet(path)


def kafka_topic(spark: SparkSession, servers: str, topic: str, earliest: bool = True, rows: int = BATCH_ROWS * 6) -> DataFrame:
    frame = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest" if earliest else "latest")
        .option("maxOffsetsPerTrigger", rows)
        .load()
    )
    return frame.select(F.col("key").cast("string").alias("key"), "value", "partition", "offset")


def _batch_time(spark: SparkSession, root: str, group: str, batch_id: int) -> datetime:
    """When the batch was first run: written once, read by every retry."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_batches/{group}/{batch_id}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, False)
        out.write(datetime.now(UTC).isoformat().encode())
        out.close()
    source = fs.open(path)
    try:
        return datetime.fromisoformat(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


class Counts:
    """Rows and batches of one consumer since it started; a retried batch counts once."""

    def __init__(self):
        self.batches: dict[int, tuple[int, int]] = {}

    def add(self, batch_id: int, records: int, rejects: int) -> None:
        self.batches[batch_id] = records, rejects

    def total(self) -> dict[str, int]:
        records, rejects = (sum(b[i] for b in self.batches.values()) for i in (0, 1))
        return {"consumed": records + rejects, "records": records, "rejects": rejects, "commits": len(self.batches)}


_COUNTS: dict[str, Counts] = {}


def sink(root: str, group: str, fail: Callable[[int], None] | None = None, counts: Counts | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function; `fail(batch_id)` runs between the two writes, for tests of a crash."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.lit(_batch_time(spark, root, group, batch_id)).cast("timestamp")
        frame = parse.parsed(batch, at).persist()
        try:
            write_bronze(parse.records(frame), root, f"{group}-{batch_id:08d}")
            if fail:
                fail(batch_id)
            write_quarantine(parse.rejects(frame), root, f"{group}-{batch_id:08d}")
            if counts is not None:
                good = F.col("error").isNull()
                counts.add(batch_id, *frame.agg(F.count_if(good), F.count_if(~good)).first())
        finally:
            frame.unpersist()

    return write


def start(
    messages: DataFrame,
    root: str,
    group: str = "bronze",
    bounded: bool = False,
    interval: str = INTERVAL,
    fail: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Consume as `group`, whose checkpoint holds its offsets: a new group replays from the beginning.

    `bounded` stops when all that is there has been read; else stop_gracefully() or run_until_signal().
    """
    counts = Counts()
    writer = messages.writeStream.foreachBatch(sink(root, group, fail, counts)).option("checkpointLocation", f"{root}/_checkpoints/{group}")
    query = (writer.trigger(availableNow=True) if bounded else writer.trigger(processingTime=interval)).start()
    _COUNTS[str(query.runId)] = counts
    return query


def stats(query: StreamingQuery) -> dict[str, int]:
    """Rows read and batches written by the query since it started, however long ago."""
    return _COUNTS[str(query.runId)].total()


def stop_gracefully(query: StreamingQuery, wait_seconds: float = 60.0) -> None:
    """Let the batch that is running end and commit, then stop. What comes later stays uncommitted, for the next start."""
    until = time.monotonic() + wait_seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.05)
    query.stop()


def run_until_signal(query: StreamingQuery, poll_seconds: float = 0.5) -> None:
    """Wait for the query's end, or for SIGINT or SIGTERM, on which it stops after its batch has been written and committed."""
    asked = threading.Event()
    before = {s: signal.signal(s, lambda *_: asked.set()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        while not asked.is_set() and not query.awaitTermination(poll_seconds):
            pass
        if asked.is_set():
            stop_gracefully(query)
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def _offsets(text) -> dict[str, dict[str, int]]:
    """{topic: {partition: offset}} of a progress report's offsets, which are JSON text; of a source without topics, nothing."""
    try:
        found = json.loads(text) if isinstance(text, str) else text or {}
    except ValueError:
        found = {}
    return {t: {str(p): int(n) for p, n in parts.items()} for t, parts in found.items() if isinstance(parts, dict)}


def kafka_lag(source: dict) -> dict[str, dict[str, int]]:
    """{topic: {partition: messages that are there and not committed}} of one source of a progress report."""
    done, there = _offsets(source.get("endOffset")), _offsets(source.get("latestOffset"))
    return {t: {p: max(0, n - done.get(t, {}).get(p, 0)) for p, n in parts.items()} for t, parts in there.items()}


def lag(query: StreamingQuery) -> list[dict[str, dict[str, int]]]:
    """Of each Kafka source, high watermark less committed offset by topic and partition, as of the last report."""
    last = query.lastProgress
    return [kafka_lag(s) for s in last["sources"]] if last else []


def file_topic_lag(spark: SparkSession, path: str, root: str) -> DataFrame:
    """partition, end, committed, lag of a file topic: its messages against those landed in bronze or quarantine."""
    from millrace.sources.lake import read_bronze, read_quarantine

    topic = spark.read.schema(MESSAGE).parquet(path).groupBy("partition").agg((F.max("offset") + 1).alias("end"))
    landed = [f(spark, root).select("kafka_partition", "kafka_offset") for f in (read_bronze, read_quarantine)]
    done = landed[0].union(landed[1]).groupBy(F.col("kafka_partition").alias("partition")).agg((F.max("kafka_offset") + 1).alias("committed"))
    both = topic.join(done, "partition", "left").withColumn("committed", F.coalesce("committed", F.lit(0)))
    return both.select("partition", "end", "committed", F.greatest(F.col("end") - F.col("committed"), F.lit(0)).alias("lag"))
