"""Messages to records or rejects: one ordered chain of Column conditions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import key_partition, strict_json

REQUIRED = ("event_id", "event_type", "machine_id", "event_time", "publish_time")
RAW_CHARS, RAW_BYTES = 500, 200
TOMBSTONE = "null value (tombstone); unexpected on this topic"
PRODUCER_CORRUPT = "corrupt payload from producer"


def parsed(messages: DataFrame, ingest_ts: Column | None = None, bootstrap: bool = False) -> DataFrame:
    """Adds the record's columns, `error` (null for a record) and `raw` to messages(key, value, partition, offset).

    `value` may be binary or string. Checks run in this order: tombstone, UTF-8, JSON, object, [bootstrap:
    a producer's raw marker], required keys in order, version, timestamps. An id that is JSON null or
    no string is a reject too.
    """
    # in steps, so that each text is checked and taken apart once
    text = F.col("value").cast("string")
    given = messages.select(
        "key",
        "value",
        F.try_validate_utf8(text).alias("text"),
        F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").cast("long").alias("kafka_offset"),
        (ingest_ts if ingest_ts is not None else F.current_timestamp()).alias("ingest_ts"),
    )
    looked = given.select(
        "*", strict_json(F.col("text")).alias("is_json"), F.json_object_keys("text").alias("keys")
    )
    names = (*REQUIRED, "schema_version", "payload", *(("_raw", "_key") if bootstrap else ()))
    # all fields in one pass over the text; of text that is not JSON, none
    whole = F.when(F.col("is_json"), F.col("text"))
    fields = looked.select("*", F.json_tuple(whole, *names).alias(*[f"f_{k}" for k in names]))
    get = lambda k: F.col(f"f_{k}")
    has = lambda k: F.array_contains("keys", k)
    typed = fields.select(
        "*",
        F.when(has("schema_version"), get("schema_version").try_cast("int")).otherwise(1).alias("schema_version"),
        *[get(k).try_cast("timestamp").alias(k) for k in ("event_time", "publish_time")],
    )

    error = F.when(F.col("value").isNull(), F.lit(TOMBSTONE))
    error = error.when(F.col("text").isNull(), F.lit("UnicodeDecodeError: invalid utf-8"))
    error = error.when(~F.col("is_json"), F.lit("JSONDecodeError: not one JSON value"))
    error = error.when(F.col("keys").isNull(), F.lit("payload is not an object"))
    if bootstrap:
        error = error.when(has("_raw"), F.lit(PRODUCER_CORRUPT))
    for k in REQUIRED:
        error = error.when(~has(k), F.lit(f"KeyError: '{k}'"))
    for k in REQUIRED[:3]:
        error = error.when(get(k).isNull(), F.lit(f"TypeError: {k} is null"))
    error = error.when(F.col("schema_version").isNull(), F.lit("ValueError: schema_version"))
    for k in ("event_time", "publish_time"):
        error = error.when(F.col(k).isNull(), F.concat(F.lit(f"ValueError: {k}: "), F.coalesce(get(k), F.lit("null"))))

    payload = get("payload")
    empty = payload.isNull() | payload.isin("", "{}", "[]", "0", "false")
    machine, hidden = F.coalesce(get("machine_id"), F.col("key")), F.col("text")
    if bootstrap:
        machine = F.when(has("_raw"), get("_key")).otherwise(machine)
        hidden = F.when(has("_raw"), get("_raw")).otherwise(hidden)
    raw = (
        F.when(F.col("value").isNull(), F.lit(""))
        .when(F.col("text").isNull(), F.hex(F.substring(F.col("value").cast("binary"), 1, RAW_BYTES)))
        .otherwise(F.substring(hidden, 1, RAW_CHARS))
    )
    return typed.select(
        "key",
        "value",
        error.alias("error"),
        raw.alias("raw"),
        get("event_id").alias("event_id"),
        get("event_type").alias("event_type"),
        machine.alias("machine_id"),
        "event_time",
        "publish_time",
        "schema_version",
        F.when(empty, F.lit("{}")).otherwise(payload).alias("payload"),
        "ingest_ts",
        "kafka_partition",
        "kafka_offset",
    )


def records(frame: DataFrame) -> DataFrame:
    """Parsed rows without an error, as bronze."""
    return frame.where("error is null").select(
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


def rejects(frame: DataFrame) -> DataFrame:
    """Parsed rows with an error, as quarantine: they keep their partition and offset."""
    return frame.where("error is not null").select(
        "raw",
        "error",
        "machine_id",
        "ingest_ts",
        "kafka_partition",
        "kafka_offset",
        F.date_format("ingest_ts", "yyyy-MM-dd").alias("dt"),
    )


def _quoted(column: str) -> Column:
    """The column as a JSON string."""
    pair = F.to_json(F.struct(F.col(column).alias("v")))
    return F.substring(pair, F.lit(6), F.length(pair) - 6)


def wire_value() -> Column:
    """One flat JSON object of an event's columns, the payload nested as it is."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    parts = [F.lit("{")]
    for c in ("event_id", "event_type", "machine_id"):
        parts += [F.lit(f'"{c}":'), _quoted(c), F.lit(",")]
    for c in ("event_time", "publish_time"):
        parts += [F.lit(f'"{c}":"'), F.date_format(c, iso), F.lit('",')]
    parts += [F.lit('"schema_version":'), F.col("schema_version").cast("string")]
    parts += [F.lit(',"payload":'), F.coalesce("payload", F.lit("{}")), F.lit("}")]
    return F.concat(*parts)


def wire(events: DataFrame) -> DataFrame:
    """Events as messages (key, value, partition)."""
    return events.select(
        F.col("machine_id").alias("key"), wire_value().alias("value"), key_partition("machine_id").alias("partition")
    )
