"""Scalar and aggregate expressions of the models, as built-in Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_SECONDS = 900
PARTITIONS = 6


def json_string(col: str | Column, key: str) -> Column:
    """Value of a top-level key as text; NULL for JSON null, a missing key or malformed text."""
    return F.get_json_object(col, f"$.{key}")


def window_start(ts: str | Column, seconds: int = WINDOW_SECONDS) -> Column:
    """Start of the tumbling window that holds ts; floors below the epoch too."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def date_diff(unit: str, a: str | Column, b: str | Column, mode: str = "elapsed") -> Column:
    """Whole units from a to b: `elapsed` counts full units, `boundary` counts clock ticks crossed."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = {"second": 1, "minute": 60, "hour": 3600}[unit]
    if mode == "boundary":
        ticks = [F.floor(F.unix_seconds(x.cast("timestamp")) / size) for x in (a, b)]
        return (ticks[1] - ticks[0]).cast("long")
    if mode != "elapsed":
        raise ValueError(f"mode {mode!r}")
    return F.timestamp_diff(unit.upper(), a, b)


def duration_seconds(duration_s: Column, duration_ms: Column) -> Column:
    """Seconds, whichever unit the contract version carried."""
    return F.coalesce(duration_s.cast("double"), duration_ms.cast("double") / 1000.0)


def id_checksum(event_id: str | Column) -> Column:
    """Aggregate: sha256 over the sorted ids, a zero byte after each; first 32 hex digits. No ids: of the empty text."""
    ids = F.array_sort(F.collect_list(event_id))
    joined = F.when(F.size(ids) == 0, F.lit("")).otherwise(F.concat(F.array_join(ids, "\0"), F.lit("\0")))
    return F.substring(F.sha2(joined, 256), 1, 32)


def key_partition(key: str | Column, partitions: int = PARTITIONS) -> Column:
    """crc32 of the key's bytes modulo the partitions; no key goes to partition 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("binary")) % partitions, F.lit(0)).cast("int")


def strict_json(value: Column) -> Column:
    """True for text that is exactly one JSON value: no trailing text, no truncation."""
    one = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    wrapped = F.size(F.json_object_keys(F.concat(F.lit('{"w":'), value, F.lit("}")))) == 1
    return F.coalesce(one & wrapped & (F.trim(value) != ""), F.lit(False))


def seconds_sum(duration: Column) -> Column:
    """Sum of seconds through whole milliseconds, so the result does not depend on row order."""
    return F.round(F.sum(F.round(duration * 1000).cast("long")) / 1000.0, 3)


def uuid_text(hex32: Column) -> Column:
    return F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def draw(seed: int, name: str, *cols: str | Column) -> Column:
    """A uniform number in [0, 1) that depends on the seed, a name and columns, not on row order."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *cols), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
