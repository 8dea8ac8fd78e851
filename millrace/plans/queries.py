"""The query catalogue: each operator as a query over the driver's tables, with its SQL for a second engine."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import contracts, data_tests, parse
from millrace.operators.manifest import build_manifest, manifest_totals
from millrace.plans import fixture, ledger, models
from millrace.plans.fixture import AS_OF
from millrace.sources import lake

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as text with microseconds, so engines need not agree on a timestamp type."""
    return df.select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    )


class Data:
    """The tables and models over one directory, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def canonical(self) -> DataFrame:
        return fixture.canonical(self.table("events"))

    @property
    def bronze(self) -> DataFrame:
        return fixture.bronze(self.canonical)

    @property
    def stg(self) -> DataFrame:
        return models.stg_events(self.bronze)

    @property
    def slv(self) -> DataFrame:
        return models.slv_events(self.stg)

    @property
    def agg(self) -> DataFrame:
        return models.agg_window_machine(self.slv)

    @property
    def manifest(self) -> DataFrame:
        return build_manifest(self.canonical)

    def ledger(self, agg: DataFrame | None = None, manifest: DataFrame | None = None, **kw) -> DataFrame:
        return ledger.completeness_ledger(self.manifest if manifest is None else manifest, self.agg if agg is None else agg, AS_OF, **kw)


EV = """
WITH ev AS (
  SELECT event_id AS i, ts, user_id AS u, user_id % 8 AS u8,
    'MW1-' || (CASE WHEN user_id % 8 < 4 THEN 'A' ELSE 'B' END) || '-0' || CAST(user_id % 4 + 1 AS VARCHAR) AS machine_id,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'cycle' WHEN event_type = 'error' THEN 'defect'
         WHEN event_type = 'view' THEN 'state_change' ELSE 'operator_scan' END AS kind,
    ts + to_seconds(CASE WHEN user_id % 8 = 1 THEN -75 WHEN user_id % 8 = 4 THEN 45 ELSE 0 END) AS event_time,
    CAST(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-24' THEN 2 ELSE 3 END AS INTEGER) AS version,
    CAST(round(value * 1000) AS BIGINT) AS ms,
    event_id % 997 = 5 AS corrupt,
    CAST(CASE WHEN event_id % 100 = 3 THEN 1 + (event_id // 100) % 3 ELSE 0 END AS INTEGER) AS extra,
    event_id % 50 = 7 AS late
  FROM events
), pub AS (
  SELECT ev.*, c,
    ts + to_milliseconds(40 + (i * 37) % 361) + to_seconds(CASE WHEN late THEN (i * 7919) % 21600 ELSE 0 END)
       + to_milliseconds(CASE WHEN c > 0 THEN 5 + 300 * c ELSE 0 END) AS publish_time
  FROM (SELECT *, unnest(range(0, extra + 1)) AS c FROM ev) ev
), stg AS (
  SELECT CAST(i AS VARCHAR) AS event_id, kind AS event_type, machine_id, event_time, publish_time, version AS schema_version,
    CASE WHEN kind = 'cycle' THEN 'OP-' || u END AS operator_badge,
    CASE WHEN version >= 2 THEN '' END AS line_id,
    CASE WHEN kind IN ('cycle', 'defect') THEN 'WO-' || u8 || '-' || (i // 200) END AS work_order,
    CASE WHEN kind IN ('cycle', 'defect') THEN 'SKU-' || (i % 4) END AS sku,
    CASE WHEN kind IN ('cycle', 'defect') THEN CAST(i AS INTEGER) END AS unit_seq,
    CASE WHEN kind = 'cycle' THEN ms / 1000.0::DOUBLE END AS duration_s,
    CASE WHEN kind = 'cycle' THEN ms END AS ms,
    CASE WHEN kind = 'defect' THEN 'D' || (i % 6) END AS defect_code,
    CASE WHEN kind = 'state_change' THEN 'IDLE' END AS from_state,
    CASE WHEN kind = 'state_change' THEN 'EXECUTE' END AS to_state,
    CASE WHEN kind = 'state_change' AND i % 2 = 1 THEN 'r' || (i % 5) END AS reason,
    CASE WHEN kind = 'operator_scan' THEN (CASE WHEN i % 2 = 0 THEN 'login' ELSE 'logout' END) END AS scan_action,
    CASE WHEN kind = 'operator_scan' THEN 'OP-' || u END AS badge_id,
    publish_time + to_seconds(2) AS ingest_ts,
    CAST(CASE WHEN u8 = 0 THEN 5 WHEN u8 IN (3, 7) THEN 4 WHEN u8 = 5 THEN 1 ELSE 3 END AS INTEGER) AS kafka_partition,
    i * 4 + c AS kafka_offset,
    date_sub('second', event_time, publish_time) AS publish_lag_s,
    strftime(publish_time + to_seconds(2), '%Y-%m-%d') AS dt,
    strftime(publish_time + to_seconds(2), '%H') AS hr
  FROM pub WHERE NOT corrupt
), slv AS (
  SELECT * EXCLUDE (dt, hr), time_bucket(INTERVAL '15 minutes', event_time) AS window_start, publish_lag_s > 60 AS is_late
  FROM stg QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY publish_time NULLS LAST, kafka_offset NULLS LAST) = 1
), agg AS (
  SELECT machine_id, window_start, count(*) AS event_count,
    count(*) FILTER (event_type = 'cycle') AS cycle_count, count(*) FILTER (event_type = 'defect') AS defect_count,
    count(*) FILTER (event_type = 'state_change') AS state_change_count, count(*) FILTER (event_type = 'operator_scan') AS operator_scan_count,
    count(*) FILTER (event_type = 'cycle') AS unit_count, round(CAST(sum(ms) AS BIGINT) / 1000.0::DOUBLE, 3) AS cycle_duration_sum_s,
    count(*) FILTER (is_late) AS late_count, max(publish_lag_s) AS max_publish_lag_s
  FROM slv GROUP BY ALL
), manifest AS (
  SELECT time_bucket(INTERVAL '15 minutes', event_time) AS window_start, machine_id,
    CAST(count(*) AS INTEGER) AS event_count,
    CAST(count(*) FILTER (kind = 'cycle') AS INTEGER) AS cycle_count,
    CAST(count(*) FILTER (kind = 'defect') AS INTEGER) AS defect_count,
    CAST(count(*) FILTER (kind = 'state_change') AS INTEGER) AS state_change_count,
    CAST(count(*) FILTER (kind = 'operator_scan') AS INTEGER) AS operator_scan_count,
    CAST(count(*) FILTER (kind = 'cycle') AS INTEGER) AS unit_count,
    coalesce(round(CAST(sum(ms) FILTER (kind = 'cycle') AS BIGINT) / 1000.0::DOUBLE, 3), 0.0::DOUBLE) AS cycle_duration_sum_s,
    left(sha256(string_agg(CAST(i AS VARCHAR) || chr(0), '' ORDER BY CAST(i AS VARCHAR))), 32) AS event_id_checksum,
    CAST(count(*) FILTER (corrupt) AS INTEGER) AS corrupt_count,
    CAST(sum(extra) AS INTEGER) AS duplicate_extra_count,
    CAST(count(*) FILTER (late) AS INTEGER) AS late_count,
    CAST(count(*) FILTER (corrupt AND kind = 'cycle') AS INTEGER) AS corrupt_cycle_count,
    CAST(count(*) FILTER (corrupt AND kind = 'defect') AS INTEGER) AS corrupt_defect_count,
    coalesce(round(CAST(sum(ms) FILTER (corrupt AND kind = 'cycle') AS BIGINT) / 1000.0::DOUBLE, 3), 0.0::DOUBLE) AS corrupt_duration_sum_s
  FROM ev GROUP BY ALL
)"""

LEDGER = """, joined AS (
  SELECT coalesce(m.machine_id, a.machine_id) AS machine_id, coalesce(m.window_start, a.window_start) AS window_start,
    coalesce(m.event_count, 0) - coalesce(m.corrupt_count, 0) AS expected_event_count, coalesce(a.event_count, 0) AS observed_event_count,
    coalesce(a.unit_count, 0) - (coalesce(m.unit_count, 0) - coalesce(m.corrupt_cycle_count, 0)) AS unit_delta,
    coalesce(a.defect_count, 0) - (coalesce(m.defect_count, 0) - coalesce(m.corrupt_defect_count, 0)) AS defect_delta,
    round(coalesce(a.cycle_duration_sum_s, 0) - (coalesce(m.cycle_duration_sum_s, 0) - coalesce(m.corrupt_duration_sum_s, 0)), 3) AS duration_delta,
    coalesce(m.corrupt_count, 0) AS injected_corrupt, coalesce(m.corrupt_cycle_count, 0) AS injected_corrupt_cycles,
    coalesce(m.duplicate_extra_count, 0) AS injected_duplicate_extra, coalesce(m.late_count, 0) AS injected_late, coalesce(a.late_count, 0) AS observed_late,
    m.machine_id IS NULL AS missing_from_manifest, a.machine_id IS NULL AS missing_from_gold
  FROM {manifest} m FULL OUTER JOIN {agg} a ON m.machine_id = a.machine_id AND m.window_start = a.window_start
), ledger AS (
  SELECT machine_id, window_start, date_sub('hour', window_start, TIMESTAMP '2024-01-31 02:00:00') AS window_age_hours,
    CAST(expected_event_count AS BIGINT) AS expected_event_count, CAST(observed_event_count AS BIGINT) AS observed_event_count,
    CAST(observed_event_count - expected_event_count AS BIGINT) AS event_delta, CAST(unit_delta AS BIGINT) AS unit_delta,
    CAST(defect_delta AS BIGINT) AS defect_delta, duration_delta,
    CAST(injected_corrupt AS BIGINT) AS injected_corrupt, CAST(injected_corrupt_cycles AS BIGINT) AS injected_corrupt_cycles,
    CAST(injected_duplicate_extra AS BIGINT) AS injected_duplicate_extra, CAST(injected_late AS BIGINT) AS injected_late,
    CAST(observed_late AS BIGINT) AS observed_late, missing_from_manifest, missing_from_gold,
    CASE WHEN missing_from_manifest OR missing_from_gold THEN 'broken'
      WHEN observed_event_count = expected_event_count AND unit_delta = 0 AND defect_delta = 0 AND abs(duration_delta) < 0.01 THEN 'reconciled'
      WHEN date_sub('hour', window_start, TIMESTAMP '2024-01-31 02:00:00') < 8 THEN 'pending' ELSE 'broken' END AS status,
    CASE WHEN missing_from_manifest THEN '{INVENTED}'
      WHEN missing_from_gold THEN '{LOST}'
      WHEN observed_event_count <> expected_event_count THEN '{EVENTS}'
      WHEN unit_delta <> 0 THEN '{UNITS}' WHEN defect_delta <> 0 THEN '{DEFECTS}'
      WHEN abs(duration_delta) >= 0.01 THEN '{DURATION}' END AS root_cause
  FROM joined
)"""


def _ledger_sql(select: str, manifest: str = "manifest", agg: str = "agg", before: str = "") -> str:
    causes = {c: getattr(ledger, c) for c in ("INVENTED", "LOST", "EVENTS", "UNITS", "DEFECTS", "DURATION")}
    return EV + before + LEDGER.format(manifest=manifest, agg=agg, **causes) + "\n" + select


def _ts(*columns: str) -> str:
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in columns)


def _star(frm: str, *times: str) -> str:
    """All columns of a CTE, timestamps as text."""
    return f"SELECT * REPLACE ({', '.join(f'''strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}''' for c in times)}) FROM {frm}"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Data(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


query("scan_events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events")(
    lambda d: d.table("events").select("event_id", "ts", "user_id", "event_type", "value", "props")
)
query("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(
    lambda d: d.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
)
query("rename_coalesce", EV + "SELECT event_id, operator_badge FROM stg")(lambda d: d.stg.select("event_id", "operator_badge"))
query("unit_conform", EV + "SELECT event_id, duration_s FROM stg WHERE event_type = 'cycle' AND duration_s IS NOT NULL")(
    lambda d: d.stg.where("event_type = 'cycle' and duration_s is not null").select("event_id", "duration_s")
)
query("publish_lag", EV + f"SELECT event_id, {_ts('event_time', 'publish_time')}, publish_lag_s FROM stg")(
    lambda d: d.stg.select("event_id", "event_time", "publish_time", "publish_lag_s")
)
query("dedupe_row_number", EV + f"SELECT event_id, {_ts('publish_time')}, kafka_offset FROM slv")(
    lambda d: models.first_copy(d.bronze).select("event_id", "publish_time", "kafka_offset")
)
query("dedupe_removed_count", EV + "SELECT (SELECT count(*) FROM stg) - (SELECT count(*) FROM slv) AS removed")(
    lambda d: d.bronze.agg((F.count(F.lit(1)) - F.count_distinct("event_id")).alias("removed"))
)
query("window_15m", EV + f"SELECT event_id, {_ts('window_start')} FROM slv")(lambda d: d.slv.select("event_id", "window_start"))
query("late_flag", EV + "SELECT event_id, is_late FROM slv")(lambda d: d.slv.select("event_id", "is_late"))
query("stg_events", EV + _star("(SELECT * EXCLUDE (ms) FROM stg)", "event_time", "publish_time", "ingest_ts"))(lambda d: d.stg)
query("slv_events", EV + _star("(SELECT * EXCLUDE (ms) FROM slv)", "event_time", "publish_time", "ingest_ts", "window_start"))(lambda d: d.slv)
query(
    "fct_cycles",
    EV + f"SELECT event_id AS cycle_key, machine_id, line_id, work_order, sku, unit_seq, duration_s, operator_badge, {_ts('event_time', 'window_start')}, is_late, schema_version FROM slv WHERE event_type = 'cycle'",
)(lambda d: models.fct_cycles(d.slv))
query(
    "fct_defects",
    EV + f"SELECT event_id AS defect_key, machine_id, work_order, sku, unit_seq, defect_code, operator_badge AS inspector, {_ts('event_time', 'window_start')}, is_late FROM slv WHERE event_type = 'defect'",
)(lambda d: models.fct_defects(d.slv))
query(
    "dim_machine",
    EV + "SELECT machine_id, max(line_id) AS line_id, strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(event_time), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS event_count, count(DISTINCT work_order) AS work_order_count FROM slv GROUP BY machine_id",
)(lambda d: models.dim_machine(d.slv))
query("agg_window_machine", EV + _star("agg", "window_start"))(lambda d: d.agg)
query(
    "count_if_by_type",
    EV + "SELECT machine_id, count(*) FILTER (event_type = 'cycle') AS cycles, count(*) FILTER (event_type = 'defect') AS defects, count(*) FILTER (event_type = 'state_change') AS state_changes, count(*) FILTER (event_type = 'operator_scan') AS scans FROM slv GROUP BY machine_id",
)(
    lambda d: d.slv.groupBy("machine_id").agg(
        *[F.count_if(F.col("event_type") == t).alias(n) for t, n in (("cycle", "cycles"), ("defect", "defects"), ("state_change", "state_changes"), ("operator_scan", "scans"))]
    )
)
query("count_distinct_orders", EV + "SELECT machine_id, count(DISTINCT work_order) AS orders FROM slv GROUP BY machine_id")(
    lambda d: d.slv.groupBy("machine_id").agg(F.count_distinct("work_order").alias("orders"))
)
query("manifest", EV + _star("manifest", "window_start"))(lambda d: d.manifest)
query("manifest_checksum", EV + f"SELECT machine_id, {_ts('window_start')}, event_id_checksum FROM manifest")(
    lambda d: d.manifest.select("machine_id", "window_start", "event_id_checksum")
)
query(
    "manifest_totals",
    EV + "SELECT count(*) AS windows, count(DISTINCT machine_id) AS machines, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(cycle_count) AS BIGINT) AS cycle_count, CAST(sum(defect_count) AS BIGINT) AS defect_count, CAST(sum(corrupt_count) AS BIGINT) AS corrupt_count, CAST(sum(duplicate_extra_count) AS BIGINT) AS duplicate_extra_count, CAST(sum(late_count) AS BIGINT) AS late_count, strftime(min(window_start), '%Y-%m-%d %H:%M:%S.%f') AS first_window, strftime(max(window_start), '%Y-%m-%d %H:%M:%S.%f') AS last_window FROM manifest",
)(lambda d: manifest_totals(d.manifest))
query(
    "full_outer_recon",
    _ledger_sql(f"SELECT machine_id, {_ts('window_start')}, missing_from_manifest, missing_from_gold FROM joined"),
)(
    lambda d: ledger.joined(d.manifest, d.agg).select(
        "machine_id", "window_start", F.col("m").isNull().alias("missing_from_manifest"), F.col("a").isNull().alias("missing_from_gold")
    )
)
query("completeness_ledger", _ledger_sql(_star("ledger", "window_start")))(lambda d: d.ledger())
query(
    "ledger_lost_window",
    _ledger_sql(_star("ledger", "window_start"), agg="kept", before=", kept AS (SELECT * FROM agg WHERE NOT (machine_id = 'MW1-A-03' AND hour(window_start) = 13))"),
)(lambda d: d.ledger(agg=d.agg.where(~((F.col("machine_id") == "MW1-A-03") & (F.hour("window_start") == 13)))))
query(
    "ledger_phantom_window",
    _ledger_sql(_star("ledger", "window_start"), manifest="kept", before=", kept AS (SELECT * FROM manifest WHERE NOT (machine_id = 'MW1-B-02' AND hour(window_start) = 9))"),
)(lambda d: d.ledger(manifest=d.manifest.where(~((F.col("machine_id") == "MW1-B-02") & (F.hour("window_start") == 9)))))
query("ledger_status_counts", _ledger_sql("SELECT status, count(*) AS n FROM ledger GROUP BY status"))(lambda d: ledger.status_counts(d.ledger()))
query(
    "ledger_per_machine",
    _ledger_sql("SELECT machine_id, count(*) AS windows, count(*) FILTER (status = 'reconciled') AS reconciled, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'broken') AS broken, CAST(sum(observed_event_count) AS BIGINT) AS events FROM ledger GROUP BY machine_id"),
)(lambda d: ledger.per_machine(d.ledger()))
query(
    "ledger_totals",
    _ledger_sql("SELECT count(*) AS windows, count(DISTINCT machine_id) AS machines, strftime(min(window_start), '%Y-%m-%d %H:%M:%S') AS first_window, strftime(max(window_start), '%Y-%m-%d %H:%M:%S') AS last_window, CAST(sum(injected_corrupt) AS BIGINT) AS corrupt, CAST(sum(injected_duplicate_extra) AS BIGINT) AS duplicate_extra, CAST(sum(injected_late) AS BIGINT) AS late, CAST(sum(observed_late) AS BIGINT) AS late_observed, CAST(sum(expected_event_count) AS BIGINT) AS expected_events, CAST(sum(observed_event_count) AS BIGINT) AS observed_events FROM ledger"),
)(lambda d: ledger.ledger_totals(d.ledger()))
query(
    "ledger_recent_topk",
    _ledger_sql(f"SELECT {_ts('window_start')}, machine_id, status, observed_event_count, injected_corrupt, injected_duplicate_extra, injected_late FROM (SELECT * FROM ledger ORDER BY window_start DESC, machine_id LIMIT 40)"),
)(lambda d: ledger.recent_windows(d.ledger()))
query(
    "ledger_broken_topk",
    _ledger_sql(f"SELECT machine_id, {_ts('window_start')}, event_delta, unit_delta, defect_delta, root_cause FROM (SELECT * FROM ledger WHERE status = 'broken' ORDER BY window_start, machine_id LIMIT 50)"),
)(lambda d: ledger.broken_windows(d.ledger()))
query("ledger_grade", _ledger_sql("SELECT count(*) AS windows, CAST(count(*) FILTER (status = 'broken') AS BIGINT) AS broken FROM ledger"))(
    lambda d: ledger.grade(d.ledger())
)
query(
    "reconciliation_totals",
    _ledger_sql("SELECT count(*) AS windows, count(*) FILTER (event_delta = 0 AND unit_delta = 0) AS exact, CAST(sum(observed_event_count) AS BIGINT) AS deduped, CAST(sum(expected_event_count) + sum(injected_corrupt) AS BIGINT) AS manifest_events, CAST(sum(injected_corrupt) AS BIGINT) AS corrupt, CAST(sum(injected_duplicate_extra) AS BIGINT) AS duplicate_extra, CAST(sum(injected_late) AS BIGINT) AS late FROM ledger"),
)(lambda d: ledger.reconciliation_totals(d.ledger()))
#: For the strict ledger: some ids that landed are others than those that were sent, with all counts as they should be.
FORGED = """, forged AS (SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 2003 = 11 THEN 'x' || event_id ELSE event_id END AS event_id) FROM slv),
truth AS (
  SELECT time_bucket(INTERVAL '15 minutes', event_time) AS window_start, machine_id,
    left(sha256(coalesce(string_agg(CAST(i AS VARCHAR) || chr(0), '' ORDER BY CAST(i AS VARCHAR)) FILTER (NOT corrupt), '')), 32) AS good
  FROM ev GROUP BY ALL
),
landed AS (
  SELECT machine_id, window_start, left(sha256(string_agg(event_id || chr(0), '' ORDER BY event_id)), 32) AS observed FROM forged GROUP BY ALL
)"""


@query(
    "ledger_strict",
    _ledger_sql(
        f"""SELECT l.machine_id, strftime(l.window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
  CASE WHEN missing_from_gold AND expected_event_count = 0 THEN 'reconciled'
    WHEN status = 'reconciled' AND good <> observed THEN (CASE WHEN window_age_hours < 8 THEN 'pending' ELSE 'broken' END) ELSE status END AS status,
  CASE WHEN missing_from_gold AND expected_event_count = 0 THEN NULL
    WHEN status = 'reconciled' AND good <> observed THEN '{ledger.CHECKSUM}' ELSE root_cause END AS root_cause
FROM ledger l LEFT JOIN truth t ON l.machine_id = t.machine_id AND l.window_start = t.window_start
LEFT JOIN landed d ON l.machine_id = d.machine_id AND l.window_start = d.window_start""",
        before=FORGED,
    ),
)
def ledger_strict(d: Data) -> DataFrame:
    event = F.col("event_id")
    forged = d.slv.withColumn("event_id", F.when(event.cast("long") % 2003 == 11, F.concat(F.lit("x"), event)).otherwise(event))
    agg, truth = models.agg_window_machine(forged, with_ids=True), build_manifest(d.canonical, with_ids=True)
    return d.ledger(agg=agg, manifest=truth, strict=True).select("machine_id", "window_start", "status", "root_cause")


query("dq_unique", EV + "SELECT event_id, count(*) AS n FROM stg GROUP BY event_id HAVING count(*) > 1")(lambda d: data_tests.unique(d.bronze, "event_id"))
query("dq_not_null", EV + "SELECT event_id FROM slv WHERE work_order IS NULL")(lambda d: data_tests.not_null(d.slv, "work_order").select("event_id"))
query("dq_accepted_values", EV + "SELECT event_id, event_type FROM slv WHERE event_type NOT IN ('cycle', 'defect')")(
    lambda d: data_tests.accepted_values(d.slv, "event_type", ["cycle", "defect"]).select("event_id", "event_type")
)
query(
    "dq_relationships",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL AND o_orderstatus = 'F')",
)(lambda d: data_tests.relationships(d.table("lineitem"), "l_orderkey", d.table("orders").where("o_orderstatus = 'F'"), "o_orderkey").select("l_orderkey", "l_linenumber"))


def _suite_sql() -> str:
    """The 25 tests, one SELECT each, over the same tables."""
    keys = {
        "slv_events": ("slv", "event_id"),
        "dim_machine": ("dim", "machine_id"),
        "fct_cycles": ("cycles", "cycle_key"),
        "fct_defects": ("defects", "defect_key"),
    }
    tests = [(f"{t}.unique_{k}", f"SELECT {k} FROM {rows} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1") for t, (rows, k) in keys.items()]
    not_null = {
        "slv_events slv": "event_id event_type machine_id event_time schema_version window_start",
        "dim_machine dim": "machine_id",
        "fct_cycles cycles": "cycle_key machine_id",
        "fct_defects defects": "defect_key",
        "agg_window_machine agg": "machine_id window_start",
        "completeness_ledger ledger": "machine_id window_start status",
    }
    for names, columns in not_null.items():
        t, rows = names.split()
        tests += [(f"{t}.not_null_{c}", f"SELECT 1 FROM {rows} WHERE {c} IS NULL") for c in columns.split()]
    accepted = {
        "slv_events.accepted_values_event_type": ("slv", "event_type", "'cycle', 'defect', 'state_change', 'operator_scan'"),
        "slv_events.accepted_values_schema_version": ("slv", "schema_version", "1, 2, 3"),
        "completeness_ledger.accepted_values_status": ("ledger", "status", "'reconciled', 'pending', 'broken'"),
    }
    tests += [(t, f"SELECT 1 FROM {rows} WHERE {c} NOT IN ({values})") for t, (rows, c, values) in accepted.items()]
    tests.append(("completeness_ledger.gate_not_broken", "SELECT 1 FROM ledger WHERE status = 'broken'"))
    for t, rows in (("fct_cycles", "cycles"), ("fct_defects", "defects")):
        tests.append((f"{t}.relationships_machine_id", f"SELECT 1 FROM {rows} WHERE machine_id NOT IN (SELECT machine_id FROM dim)"))
    marts = """, dim AS (SELECT machine_id FROM slv GROUP BY machine_id),
cycles AS (SELECT event_id AS cycle_key, machine_id FROM slv WHERE event_type = 'cycle'),
defects AS (SELECT event_id AS defect_key, machine_id FROM slv WHERE event_type = 'defect')"""
    return _ledger_sql(" UNION ALL ".join(f"SELECT '{t}' AS test, count(*) AS failures FROM ({rows}) AS t" for t, rows in tests), before=marts)


@query("dq_suite", _suite_sql())
def dq_suite(d: Data) -> DataFrame:
    """Silver is stored once, as a build does, and read by the models and the tests."""
    from millrace.streaming.windows import scratch

    root = scratch(d.spark, "dq-suite")
    slv = lake.save_model(d.slv, root, "slv_events")
    agg = lake.save_model(models.agg_window_machine(slv), root, "agg_window_machine")
    rows = lake.save_model(d.ledger(agg=agg), root, "completeness_ledger")
    return data_tests.lakehouse_suite(slv, models.dim_machine(slv), models.fct_cycles(slv), models.fct_defects(slv), rows, agg)


def _parsed(d: Data) -> DataFrame:
    return parse.parsed(fixture.messages(d.canonical), F.col("ingest_ts"))


query(
    "parse_records",
    EV + "SELECT event_id, event_type, machine_id, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time, strftime(publish_time, '%Y-%m-%d %H:%M:%S.%f') AS publish_time, schema_version, kafka_partition, kafka_offset, dt, hr FROM stg",
)(
    lambda d: parse.records(_parsed(d)).select(
        "event_id", "event_type", "machine_id", "event_time", "publish_time", "schema_version", "kafka_partition", "kafka_offset", "dt", "hr"
    )
)
query(
    "quarantine_split",
    EV + "SELECT machine_id, CAST(CASE WHEN u8 = 0 THEN 5 WHEN u8 IN (3, 7) THEN 4 WHEN u8 = 5 THEN 1 ELSE 3 END AS INTEGER) AS kafka_partition, i * 4 + c AS kafka_offset, 'JSONDecodeError: not one JSON value' AS error FROM pub WHERE corrupt",
)(lambda d: parse.rejects(_parsed(d)).select("machine_id", "kafka_partition", "kafka_offset", "error"))


def _contract_messages(d: Data) -> DataFrame:
    return fixture.messages(fixture.canonical(d.table("events"), violations=True))


query(
    "contract_violations",
    EV + "SELECT i * 4 + c AS kafka_offset, CAST((CASE WHEN i % 500 = 9 THEN 1 ELSE 0 END) + (CASE WHEN ms <= 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_errors FROM pub WHERE NOT corrupt AND kind = 'cycle' AND (i % 500 = 9 OR ms <= 0)",
)(lambda d: contracts.validate(_contract_messages(d)).where("size(errors) > 0").select(F.col("offset").alias("kafka_offset"), F.size("errors").alias("n_errors")))
query(
    "contract_version_counts",
    EV + "SELECT version AS schema_version, count(*) AS n, count(*) FILTER (kind = 'cycle' AND (i % 500 = 9 OR ms <= 0)) AS failed FROM pub WHERE NOT corrupt GROUP BY version",
)(
    lambda d: contracts.validate(_contract_messages(d))
    .groupBy(F.get_json_object("value", "$.schema_version").cast("int").alias("schema_version"))
    .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") > 0).alias("failed"))
)
query(
    "avg_by_version",
    EV + "SELECT schema_version, round(CAST(sum(ms) AS BIGINT) / 1000.0::DOUBLE / count(*), 6) AS avg_duration_s FROM slv WHERE event_type = 'cycle' GROUP BY schema_version",
)(
    lambda d: d.slv.where("event_type = 'cycle' and duration_s is not null")
    .groupBy("schema_version")
    .agg(F.round(F.sum(F.round(F.col("duration_s") * 1000).cast("long")) / 1000.0 / F.count(F.lit(1)), 6).alias("avg_duration_s"))
)
query("partition_spread", EV + "SELECT kafka_partition, count(*) AS n, count(DISTINCT machine_id) AS machines FROM stg GROUP BY kafka_partition")(
    lambda d: d.bronze.groupBy("kafka_partition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("machine_id").alias("machines"))
)
query("distinct_versions", EV + "SELECT DISTINCT schema_version FROM slv")(lambda d: d.slv.select("schema_version").distinct())
query(
    "machine_first_last",
    EV + "SELECT machine_id, strftime(min(window_start), '%Y-%m-%d %H:%M:%S.%f') AS first_window, strftime(max(window_start), '%Y-%m-%d %H:%M:%S.%f') AS last_window, count(*) AS windows FROM agg GROUP BY machine_id",
)(lambda d: d.agg.groupBy("machine_id").agg(F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"), F.count(F.lit(1)).alias("windows")))
query(
    "defects_with_cycles",
    EV + "SELECT d.event_id AS defect_key, c.event_id AS cycle_key FROM slv d JOIN slv c ON d.event_type = 'defect' AND c.event_type = 'cycle' AND d.work_order = c.work_order AND d.unit_seq = c.unit_seq + 1",
)(
    lambda d: models.defects_with_cycles(
        models.fct_defects(d.slv), models.fct_cycles(d.slv).withColumn("unit_seq", F.col("unit_seq") + 1)
    ).select("defect_key", "cycle_key")
)
query(
    "machine_history",
    EV + """, h AS (SELECT machine_id, schema_version, event_time, event_id FROM slv QUALIFY schema_version IS DISTINCT FROM lag(schema_version) OVER (PARTITION BY machine_id ORDER BY event_time, event_id))
SELECT machine_id, schema_version, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(lead(event_time) OVER w, '%Y-%m-%d %H:%M:%S.%f') AS valid_to, lead(event_time) OVER w IS NULL AS is_current FROM h WINDOW w AS (PARTITION BY machine_id ORDER BY event_time, event_id)""",
)(lambda d: models.machine_history(d.slv))
query(
    "trailing_reprocess",
    EV + _star("agg", "window_start"),
)(
    lambda d: models.trailing_reprocess(
        models.agg_window_machine(d.slv.where(F.col("event_type") != "defect")).where(F.lit(False)).unionByName(
            d.agg.where(F.col("window_start") < F.lit("2024-01-20").cast("timestamp"))
        ),
        d.slv,
        F.lit("2024-01-20").cast("timestamp"),
    )
)
query(
    "recon_orders_lineitem",
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, round(CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE, 2) AS quantity FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(o.o_orderstatus, 'none') AS status, count(*) AS keys, count(*) FILTER (o.k IS NULL) AS missing_orders, count(*) FILTER (l.k IS NULL) AS missing_lines, CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS lines FROM o FULL OUTER JOIN l ON o.k = l.k GROUP BY 1""",
)(
    lambda d: d.table("orders")
    .where("o_orderstatus <> 'P'")
    .select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    .join(d.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), "k", "full_outer")
    .groupBy(F.coalesce("o_orderstatus", F.lit("none")).alias("status"))
    .agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("o_orderstatus").isNull()).alias("missing_orders"),
        F.count_if(F.col("n").isNull()).alias("missing_lines"),
        F.sum(F.coalesce("n", F.lit(0))).alias("lines"),
    )
)


@query(
    "stream_window_agg",
    EV + """SELECT machine_id, strftime(time_bucket(INTERVAL '15 minutes', event_time), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS event_count, count(*) FILTER (kind = 'cycle') AS cycle_count, count(*) FILTER (kind = 'defect') AS defect_count, round(CAST(sum(ms) FILTER (kind = 'cycle') AS BIGINT) / 1000.0::DOUBLE, 3) AS cycle_duration_sum_s FROM ev GROUP BY ALL""",
)
def stream_window_agg(d: Data) -> DataFrame:
    """A file stream through the windowed aggregate in update mode; each window's last row is its result."""
    from millrace.streaming.windows import run_to_files, window_counts

    stream = d.spark.readStream.schema(d.table("events").schema).parquet(f"{d.dir}/events*.parquet")
    return run_to_files(window_counts(fixture.canonical(stream)), ["machine_id", "window_start"])


@query(
    "stream_bronze",
    EV + "SELECT machine_id, count(*) AS records FROM pub WHERE NOT corrupt GROUP BY machine_id",
)
def stream_bronze(d: Data) -> DataFrame:
    """The consumer over a file topic: micro-batches to bronze and quarantine, read back."""
    from millrace.streaming import consumer
    from millrace.streaming.windows import scratch

    root = scratch(d.spark, "stream-bronze")
    lake.write_topic(fixture.messages(d.canonical), f"{root}/topic")
    consumer.start(consumer.file_topic(d.spark, f"{root}/topic"), root, bounded=True).awaitTermination()
    return lake.read_bronze(d.spark, root).groupBy("machine_id").agg(F.count(F.lit(1)).alias("records"))


@query("generate_at_scale")
def generate_at_scale(d: Data) -> DataFrame:
    """The generator and the Column-mode injector: messages by machine and kind."""
    from millrace.plans.generate import at_scale
    from millrace.sources.plant import Scenario

    sent, _ = at_scale(d.spark, Scenario())
    return sent.groupBy("key", "partition").agg(
        F.count(F.lit(1)).alias("sent"), F.count_if(F.col("copy") > 0).alias("copies"), F.count_if(F.col("corrupt_text").isNotNull()).alias("corrupt")
    )


@query("contract_compatibility", "SELECT * FROM (VALUES (1, 2, 'NONE'), (2, 3, 'NONE')) AS t(old_version, new_version, compatibility)")
def contract_compatibility(d: Data) -> DataFrame:
    rows = [(a, b, contracts.compare(a, b).compatibility) for a, b in ((1, 2), (2, 3))]
    return d.spark.createDataFrame(rows, "old_version int, new_version int, compatibility string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["completeness_ledger"](spark, sf_dir)


