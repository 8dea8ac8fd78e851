"""Declared schemas; nothing is inferred. Parquet reads come back nullable, so NOT NULL is tested, not assumed."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_S, _I, _L, _D, _T = StringType(), IntegerType(), LongType(), DoubleType(), TimestampType()


def _schema(*fields) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


BRONZE = _schema(
    ("event_id", _S, False),
    ("event_type", _S, False),
    ("machine_id", _S, False),
    ("event_time", _T, False),
    ("publish_time", _T, False),
    ("schema_version", _I, False),
    ("payload", _S, True),
    ("ingest_ts", _T, False),
    ("kafka_partition", _I, False),
    ("kafka_offset", _L, False),
    ("dt", _S, True),
    ("hr", _S, True),
)

QUARANTINE = _schema(
    ("raw", _S, True),
    ("error", _S, False),
    ("machine_id", _S, True),
    ("ingest_ts", _T, False),
    ("kafka_partition", _I, False),
    ("kafka_offset", _L, False),
    ("dt", _S, True),
)

MANIFEST_MEASURES = (
    "event_count",
    "cycle_count",
    "defect_count",
    "state_change_count",
    "operator_scan_count",
    "unit_count",
    "cycle_duration_sum_s",
    "event_id_checksum",
    "corrupt_count",
    "duplicate_extra_count",
    "late_count",
    "corrupt_cycle_count",
    "corrupt_defect_count",
    "corrupt_duration_sum_s",
)

MANIFEST = _schema(
    ("window_start", _T, False),
    ("machine_id", _S, False),
    *[
        (m, _S if m.endswith("checksum") else _D if m.endswith("_s") else _I, False)
        for m in MANIFEST_MEASURES
    ],
)

#: A generated event before it is published.
EVENT = _schema(
    ("event_id", _S, False),
    ("event_type", _S, False),
    ("machine_id", _S, False),
    ("event_time", _T, False),
    ("publish_time", _T, False),
    ("schema_version", _I, False),
    ("payload", _S, True),
)

#: A message on the topic.
MESSAGE = _schema(("key", _S, True), ("value", _S, True), ("partition", _I, False), ("offset", _L, False))

PAYLOAD_KEYS = (
    "work_order",
    "sku",
    "unit_seq",
    "duration_s",
    "duration_ms",
    "operator",
    "operator_badge",
    "line_id",
    "defect_code",
    "inspector",
    "from_state",
    "to_state",
    "reason",
    "action",
    "badge_id",
)

#: All versions' payload keys as text: parsed once per row instead of once per key.
PAYLOAD = _schema(*[(k, _S, True) for k in PAYLOAD_KEYS])

EVENT_TYPES = ("cycle", "defect", "state_change", "operator_scan")
SCHEMA_VERSIONS = (1, 2, 3)
STATUSES = ("reconciled", "pending", "broken")
