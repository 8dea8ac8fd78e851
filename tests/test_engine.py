"""Expressions, parser, models, ledger, data tests: literal rows with known answers."""

import hashlib
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import exprs
from millrace.operators import data_tests, parse
from millrace.operators.manifest import build_manifest, manifest_totals
from millrace.plans import ledger as led
from millrace.plans import models
from millrace.schemas import BRONZE, MESSAGE

T0 = datetime(2026, 3, 2, 8, 0, tzinfo=UTC)
EVENT_ID = "6f1c8f4e-1f9a-4c2b-9f3d-2b7a1e5c8d90"
GOOD = (
    '{"event_id":"%s","event_type":"cycle","machine_id":"MW1-A-01","event_time":"2026-03-02T08:00:00+00:00",'
    '"publish_time":"2026-03-02T08:00:01+00:00","schema_version":1,"payload":{"b":2,"a":1}}' % EVENT_ID
)


def one(spark, column, *values, schema):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


def test_window_start_floors_before_the_epoch_too(spark):
    rows = [(datetime(2026, 3, 2, 8, 14, 59, 999999, UTC),), (datetime(1969, 12, 31, 23, 59, tzinfo=UTC),), (None,)]
    got = spark.createDataFrame(rows, "t timestamp").select(exprs.window_start("t").cast("string").alias("w")).collect()
    assert [r.w for r in got] == ["2026-03-02 08:00:00", "1969-12-31 23:45:00", None]


def test_date_diff_modes(spark):
    a, b = datetime(2026, 1, 1, 0, 0, 0, 900000, UTC), datetime(2026, 1, 1, 0, 0, 1, 100000, UTC)
    schema = "a timestamp, b timestamp"
    assert one(spark, exprs.date_diff("second", "a", "b"), a, b, schema=schema) == 0
    assert one(spark, exprs.date_diff("second", "a", "b", "boundary"), a, b, schema=schema) == 1
    assert one(spark, exprs.date_diff("second", "b", "a"), a, b, schema=schema) == 0
    with pytest.raises(ValueError):
        exprs.date_diff("second", "a", "b", "other")


def test_checksum(spark):
    check = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string").agg(exprs.id_checksum("id")).first()[0]
    assert check("abc") == check("cab") == "13e228567e8249fce53337f25d7970de"
    assert check(["a", "b"]) != check(["a", "c"]) and check(["ab"]) != check(["a", "b"])
    assert check([]) == hashlib.sha256(b"").hexdigest()[:32]


def test_key_partition(spark):
    keys = ["MW1-A-01", "MW1-A-02", "MW1-A-03", "MW1-A-04", "MW1-B-01", "MW1-B-02", "MW1-B-03", "MW1-B-04", None]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(exprs.key_partition("k")).collect()
    assert [r[0] for r in got] == [5, 3, 3, 4, 3, 1, 3, 4, 0]


def parsed(spark, values, bootstrap=False, key="MW1-B-02"):
    rows = [(key, v, 3, 10 + i) for i, v in enumerate(values)]
    schema = "key string, value binary, partition int, offset long" if any(isinstance(v, bytes) for v in values) else MESSAGE
    at = F.lit("2026-08-16 14:37:12").cast("timestamp")
    return parse.parsed(spark.createDataFrame(rows, schema), at, bootstrap)


def test_record_and_payload_order(spark):
    frame = parsed(spark, [GOOD])
    r = parse.records(frame).first()
    assert (r.event_id, r.machine_id, r.payload, r.kafka_partition, r.kafka_offset) == (EVENT_ID, "MW1-A-01", '{"b":2,"a":1}', 3, 10)
    assert (r.dt, r.hr, r.schema_version) == ("2026-08-16", "14", 1) and parse.rejects(frame).count() == 0


@pytest.mark.parametrize(
    ("value", "prefix"),
    [
        ('{"event_id": "abc", "event_ty', "JSONDecodeError"),
        ("{", "JSONDecodeError"),
        ("", "JSONDecodeError"),
        (GOOD + " trailing", "JSONDecodeError"),
        ('"just a string"', "payload is not an object"),
        ("[1]", "payload is not an object"),
        (GOOD.replace('"event_time"', '"other"'), "KeyError: 'event_time'"),
        (GOOD.replace("2026-03-02T08:00:00+00:00", "not-a-timestamp"), "ValueError: event_time"),
        (GOOD.replace('"schema_version":1', '"schema_version":"x"'), "ValueError: schema_version"),
        (GOOD.replace(f'"{EVENT_ID}"', "null"), "TypeError: event_id"),
        (None, parse.TOMBSTONE),
    ],
)
def test_rejects(spark, value, prefix):
    frame = parsed(spark, [value])
    r = parse.rejects(frame).first()
    assert r.error.startswith(prefix) and r.kafka_offset == 10 and parse.records(frame).count() == 0
    assert r.raw == ("" if value is None else value[:500])
    if prefix == "JSONDecodeError":
        assert r.machine_id == "MW1-B-02"


def test_bad_bytes_and_missing_payload(spark):
    frame = parsed(spark, [b"\xff\xfe\x00garbage", GOOD.encode(), GOOD.replace('{"b":2,"a":1}', "null").encode()])
    assert parse.rejects(frame).first().error.startswith("UnicodeDecodeError")
    assert sorted(r.payload for r in parse.records(frame).collect()) == ['{"b":2,"a":1}', "{}"]


def test_bootstrap_marker(spark):
    r = parse.rejects(parsed(spark, ['{"_key":"MW1-A-02","_raw":"{"}'], bootstrap=True)).first()
    assert (r.error, r.machine_id, r.raw) == (parse.PRODUCER_CORRUPT, "MW1-A-02", "{")


def bronze(spark, rows):
    """rows: event_id, type, machine, event offset s, publish lag s, version, payload, offset."""
    full = [
        (i, k, m, T0 + timedelta(seconds=e), T0 + timedelta(seconds=e + lag), v, p, T0, 0, o, "2026-03-02", "08")
        for i, k, m, e, lag, v, p, o in rows
    ]
    return spark.createDataFrame(full, BRONZE)


def test_models(spark):
    cycle = '{"work_order":"W","sku":"S","unit_seq":%d,%s}'
    slv = models.slv_events(
        models.stg_events(
            bronze(
                spark,
                [
                    ("a", "cycle", "M", 0, 5, 1, cycle % (1, '"duration_s":64.2,"operator":"OP"'), 7),
                    ("a", "cycle", "M", 0, 2, 1, cycle % (1, '"duration_s":64.2,"operator":"OP"'), 9),
                    ("a", "cycle", "M", 0, 2, 1, cycle % (1, '"duration_s":64.2,"operator":"OP"'), 8),
                    ("b", "cycle", "M", 899, 61, 3, cycle % (2, '"duration_ms":64200,"operator_badge":"OQ","line_id":""'), 1),
                    ("c", "defect", "M", 900, 60, 2, '{"work_order":"W","sku":"S","unit_seq":2,"defect_code":"D","inspector":"I"}', 2),
                    ("d", "operator_scan", "N", 10, -70, 1, '{"badge_id":"B","action":"login","work_order":null}', 3),
                ],
            )
        )
    )
    rows = {r.event_id: r for r in slv.collect()}
    assert len(slv.columns) == 24 and len(rows) == 4 and rows["a"].kafka_offset == 8
    assert rows["b"].duration_s == 64.2 and rows["b"].operator_badge == "OQ" and rows["a"].operator_badge == "OP"
    assert [rows[k].is_late for k in "abcd"] == [False, True, False, False]
    assert rows["d"].scan_action == "login" and rows["a"].line_id is None and rows["b"].line_id == ""
    agg = {(r.machine_id, r.window_start.minute): r for r in models.agg_window_machine(slv).collect()}
    assert agg["M", 0].cycle_duration_sum_s == 128.4 and agg["M", 0].late_count == 1 and agg["N", 0].cycle_duration_sum_s is None
    dim = {r.machine_id: r for r in models.dim_machine(slv).collect()}
    assert dim["M"].work_order_count == 1 and dim["N"].work_order_count == 0 and dim["M"].line_id == ""
    assert models.fct_defects(slv).first().inspector is None
    joined = models.defects_with_cycles(models.fct_defects(slv), models.fct_cycles(slv)).collect()
    assert [(r.defect_key, r.cycle_key) for r in joined] == [("c", "b")]


def truth(spark, rows):
    """rows: id, type, machine, event offset s, duration, corrupt, extra, late."""
    return build_manifest(
        spark.createDataFrame(
            [(i, k, m, T0 + timedelta(seconds=e), d, c, x, late) for i, k, m, e, d, c, x, late in rows],
            "event_id string, event_type string, machine_id string, event_time timestamp, duration_s double, is_corrupt boolean, duplicate_extra int, is_late boolean",
        )
    )


def gold(spark, rows):
    out = [(m, T0 + timedelta(seconds=e // 900 * 900), n, c, d, s) for m, e, n, c, d, s in rows]
    return spark.createDataFrame(
        out, "machine_id string, window_start timestamp, event_count long, unit_count long, defect_count long, cycle_duration_sum_s double"
    ).withColumn("late_count", F.lit(0).cast("long"))


BASE = [("a", "cycle", "M", 0, 10.0, False, 0, False), ("b", "cycle", "M", 1, 20.0, True, 0, False), ("c", "defect", "M", 2, None, False, 1, True)]


@pytest.mark.parametrize(
    ("agg", "age_h", "status", "cause"),
    [
        ([("M", 0, 2, 1, 1, 10.0)], 9, "reconciled", None),
        ([("M", 0, 2, 1, 1, 10.009)], 9, "reconciled", None),
        ([("M", 0, 2, 1, 1, 10.02)], 9, "broken", led.DURATION),
        ([("M", 0, 1, 1, 0, 10.0)], 9, "broken", led.EVENTS),
        ([("M", 0, 1, 1, 0, 10.0)], 7.9, "pending", led.EVENTS),
        ([("M", 0, 2, 0, 1, 10.0)], 9, "broken", led.UNITS),
        ([("M", 0, 2, 1, 2, 10.0)], 9, "broken", led.DEFECTS),
        ([], 1, "broken", led.LOST),
    ],
)
def test_ledger_status(spark, agg, age_h, status, cause):
    r = led.completeness_ledger(truth(spark, BASE), gold(spark, agg), T0 + timedelta(hours=age_h)).collect()
    assert len(r) == 1 and (r[0].status, r[0].root_cause) == (status, cause)
    assert r[0].injected_corrupt_cycles == 1 and r[0].injected_duplicate_extra == 1 and r[0].injected_late == 1


def test_ledger_invented_window_and_strict_mode(spark):
    ledger = led.completeness_ledger(truth(spark, BASE), gold(spark, [("M", 0, 2, 1, 1, 10.0), ("X", 0, 1, 1, 0, 1.0)]), T0)
    assert len(ledger.columns) == 18
    rows = {r.machine_id: r for r in ledger.collect()}
    assert rows["X"].status == "broken" and rows["X"].root_cause == led.INVENTED and rows["X"].missing_from_manifest
    lost = [("b", "cycle", "M", 1, 20.0, True, 0, False)]
    for strict, want in ((False, "broken"), (True, "reconciled")):
        assert led.completeness_ledger(truth(spark, lost), gold(spark, []), T0, strict=strict).first().status == want
    m = truth(spark, BASE).withColumn("good_checksum", F.lit("x"))
    a = gold(spark, [("M", 0, 2, 1, 1, 10.0)]).withColumn("observed_checksum", F.lit("y"))
    swapped = led.completeness_ledger(m, a, T0 + timedelta(hours=9), strict=True).first()
    assert (swapped.status, swapped.root_cause) == ("broken", led.CHECKSUM)
    assert led.completeness_ledger(m, a, T0).first().status == "reconciled"


def test_manifest_totals(spark):
    r = manifest_totals(truth(spark, [*BASE, ("d", "state_change", "N", 1000, None, False, 2, False)])).first()
    assert (r.windows, r.machines, r.event_count, r.corrupt_count, r.duplicate_extra_count) == (2, 2, 4, 1, 3)


def test_data_tests(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "z")], "k int, v string")
    assert [r.k for r in data_tests.unique(df, "k").collect()] == [1]
    assert data_tests.not_null(df, "v").count() == 1
    assert data_tests.accepted_values(df, "v", ["a", "b"]).count() == 1
    assert data_tests.relationships(df, "k", df.where("k = 2"), "k").count() == 2
    assert data_tests.expression_is_true(df, "k > 1").count() == 3
    results = data_tests.column_tests(df, "t", [data_tests.ColumnTest.not_null("k"), data_tests.ColumnTest.holds("two", "k < 3")])
    assert {r.test: r.failures for r in results.collect()} == {"t.not_null_k": 1, "t.two": 1}
    with pytest.raises(data_tests.DataTestFailure, match="not_null_k"):
        data_tests.enforce(results)
    data_tests.enforce(results.where("failures = 0"))
