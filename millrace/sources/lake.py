"""Readers and writers of the lake: JSON lines, bronze, quarantine, manifests, model tables.

Layout: bronze/dt=/hr=/batch=, quarantine/dt=/batch=, manifests/dt=. A batch rewrites its own
partitions only (dynamic overwrite), so a replayed batch replaces what it wrote. Readers list directories; there is
no partition registry to go stale. Any Hadoop URI is a root.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from millrace.functions.exprs import key_partition
from millrace.operators import parse
from millrace.schemas import BRONZE, MANIFEST, MESSAGE, QUARANTINE


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: raw lines, blank ones skipped; the raw text stays available to the parser."""
    return spark.read.text(path).where(F.trim("value") != "")


def bootstrap_messages(lines: DataFrame) -> DataFrame:
    """Lines as messages without a broker: partition by the key's hash, one rising offset in each.

    Offsets follow the order of the lines in the files. They are counted in two levels (lines of a task, then tasks), so
    no partition of the topic is gathered in one task.
    """
    key = F.coalesce(F.get_json_object("value", "$._key"), F.get_json_object("value", "$.machine_id"))
    task, line = F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("line")
    return numbered(lines.select(key.alias("key"), "value", task, line).withColumn("partition", key_partition("key")))


def numbered(keyed: DataFrame) -> DataFrame:
    """Messages (key, value, partition, task, line) with the offset of each in its partition, in place of task and line."""
    within = W.partitionBy("partition", "task").orderBy("line")
    counts = keyed.groupBy("partition", "task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("partition").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("partition", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        keyed.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["partition", "task"])
        .select("key", "value", "partition", (F.col("start") + F.col("place")).cast("long").alias("offset"))
    )


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("batch", StringType())


def _write(df: DataFrame, path: str, *by: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy(*by)
        .parquet(path)
    )


def write_bronze(records: DataFrame, root: str, batch: str) -> None:
    _write(records.withColumn("batch", F.lit(batch)), f"{root}/bronze", "dt", "hr", "batch")


def write_quarantine(rejects: DataFrame, root: str, batch: str) -> None:
    _write(rejects.withColumn("batch", F.lit(batch)), f"{root}/quarantine", "dt", "batch")


def write_manifest(manifest: DataFrame, root: str) -> None:
    """One directory for each day. A day that is written again keeps what it held of other windows, so rewriting a
    window is idempotent."""
    manifest = manifest.select(*MANIFEST.fieldNames())
    path, own = f"{root}/manifests", MANIFEST.fieldNames()
    day = F.date_format("window_start", "yyyy-MM-dd")
    held = manifest.sparkSession.createDataFrame([], manifest.schema)
    try:
        held = manifest.sparkSession.read.schema(manifest.schema).parquet(path).select(*own)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):  # nothing written yet
            raise
    kept = held.join(manifest.select(day.alias("dt")).distinct(), day == F.col("dt"), "left_semi")
    kept = kept.join(manifest.select("window_start").distinct(), "window_start", "left_anti").select(*own)
    both = manifest.unionByName(kept).withColumn("dt", day)
    _write(both.repartition("dt"), path, "dt")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(_with_batch(schema)).parquet(path).select(*schema.fieldNames())
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):  # nothing written yet
            return spark.createDataFrame([], schema)
        raise


def _read_topic(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MESSAGE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], MESSAGE)
        raise


def read_bronze(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/bronze", BRONZE)


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/quarantine", QUARANTINE)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests").select(*MANIFEST.fieldNames())


MODELS = ("slv_events", "agg_window_machine", "dim_machine", "fct_cycles", "fct_defects", "completeness_ledger")


def register_views(spark: SparkSession, root: str) -> list[str]:
    """The lake's tables and the models that have been built, as views that spark.sql() can name; their names."""
    names = []
    for name, frame in (("bronze", read_bronze), ("quarantine", read_quarantine), ("manifests", read_manifests)):
        frame(spark, root).createOrReplaceTempView(name)
        names.append(name)
    for name in MODELS:
        try:
            spark.read.parquet(f"{root}/warehouse/{name}").createOrReplaceTempView(name)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):  # not built yet
                raise
        else:
            names.append(name)
    return names


def register_tables(spark: SparkSession, root: str, database: str) -> list[str]:
    """The lake's tables in the catalog, as external tables over their directories; partitions that are there are found.
    A reader sees directories that come later after another call."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    names = []
    for name, schema, by in (("bronze", BRONZE, ("dt", "hr", "batch")), ("quarantine", QUARANTINE, ("dt", "batch")), ("manifests", MANIFEST, ("dt",))):
        kept = StructType([f for f in schema.fields if f.name not in by])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
        parts = ", ".join(f"`{c}` string" for c in by)
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.{name}")  # external: its files stay
        spark.sql(f"CREATE TABLE `{database}`.{name} ({columns}, {parts}) USING parquet PARTITIONED BY ({', '.join(by)}) LOCATION '{root}/{name}'")
        spark.sql(f"MSCK REPAIR TABLE `{database}`.{name}")
        names.append(f"{database}.{name}")
    return names


def _broken(messages: DataFrame) -> bool:
    return "corrupt_text" in messages.columns


def write_events(messages: DataFrame, path: str) -> None:
    """messages(key, value[, corrupt_text]) as JSON lines; a corrupt one as its key and raw text."""
    value = F.col("value")
    if _broken(messages):
        broken = F.to_json(F.struct(F.col("key").alias("_key"), F.col("corrupt_text").alias("_raw")))
        value = F.when(F.col("corrupt_text").isNotNull(), broken).otherwise(value)
    messages.select(value.alias("value")).write.mode("overwrite").text(path)


def as_sent(messages: DataFrame) -> DataFrame:
    """messages as they go to a topic: a corrupt one has its broken text as its value."""
    return messages.withColumn("value", F.coalesce("corrupt_text", "value")) if _broken(messages) else messages


def published(lines: DataFrame) -> DataFrame:
    """JSON lines as messages for a topic: keyed by machine; a marked corrupt line keeps its key and sends its raw text."""
    raw = F.get_json_object("value", "$._raw")
    marked = F.array_contains(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), "_raw")
    sent = bootstrap_messages(lines)
    return sent.withColumn("value", F.when(marked, F.coalesce(raw, F.lit(""))).otherwise(F.col("value")))


def after_last(messages: DataFrame, path: str) -> DataFrame:
    """messages with their offsets moved behind the last of each partition of a file topic."""
    last = _read_topic(messages.sparkSession, path).groupBy("partition").agg((F.max("offset") + 1).alias("next"))
    moved = messages.join(F.broadcast(last), "partition", "left")  # a row for each partition of the topic
    return moved.withColumn("offset", F.col("offset") + F.coalesce("next", F.lit(0))).drop("next")


def write_topic(messages: DataFrame, path: str) -> None:
    """A file topic: key, value, partition, offset as Parquet, appended. Messages without an offset get the next ones of
    their partition, in the order of the injector's places or slots."""
    messages = as_sent(messages)
    if "offset" not in messages.columns:
        by = [c for c in ("place", "key", "slot", "copy") if c in messages.columns]
        ordered = messages.repartitionByRange(*by).sortWithinPartitions(*by)
        task, line = F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("line")
        messages = after_last(numbered(ordered.select("key", "value", "partition", task, line)), path)
    messages.select(*MESSAGE.fieldNames()).write.mode("append").parquet(path)


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """To a broker, with the partition set so that the layout does not depend on a client's hash."""
    (
        as_sent(messages)
        .select("key", "value", "partition")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .option("kafka.compression.type", "snappy")
        .option("kafka.linger.ms", "20")
        .option("topic", topic)
        .save()
    )


def publish(spark: SparkSession, events: str, topic: str, servers: str | None = None) -> dict[str, int]:
    """JSON lines to a broker's topic, or to a file topic where no servers are named.

    A write that fails raises, and Spark's sinks take a batch or refuse it, so of what is counted none has failed.
    """
    messages = published(read_lines(spark, events))
    if servers:
        write_kafka(messages, servers, topic)
    else:
        write_topic(after_last(messages, topic), topic)
    return {"sent": messages.count(), "failed": 0}


def load(spark: SparkSession, events: str, manifest: str | None, root: str, batch: str = "bootstrap") -> dict[str, int]:
    """The broker-free load: JSON lines to bronze and quarantine, manifest lines to manifests."""
    frame = parse.parsed(bootstrap_messages(read_lines(spark, events)), bootstrap=True).persist()
    try:
        write_bronze(parse.records(frame), root, batch)
        write_quarantine(parse.rejects(frame), root, batch)
        counts = frame.agg(F.count_if(F.col("error").isNull()).alias("r"), F.count_if(F.col("error").isNotNull()).alias("q")).first()
    finally:
        frame.unpersist()
    out = {"bronze": counts.r, "quarantine": counts.q}
    if manifest:
        write_manifest(read_manifest_lines(spark, manifest), root)
        out["windows"] = read_manifests(spark, root).count()
    return out


def save_model(df: DataFrame, root: str, name: str) -> DataFrame:
    """A model as a table: written, then read back, so its readers do not compute it again."""
    path = f"{root}/warehouse/{name}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expire(spark: SparkSession, root: str, before: str, tables: tuple[str, ...] = ("bronze", "quarantine")) -> list[str]:
    """Drops the dt= directories of days before `before` (yyyy-MM-dd); manifests are never expired."""
    jvm = spark.sparkContext._jvm
    dropped = []
    for t in tables:
        top = jvm.org.apache.hadoop.fs.Path(f"{root}/{t}")
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(top) if fs.exists(top) else []:
            name = status.getPath().getName()
            if name.startswith("dt=") and name[3:] < before:
                fs.delete(status.getPath(), True)
                dropped.append(f"{t}/{name}")
    return sorted(dropped)
