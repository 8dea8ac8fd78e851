"""Publishing, consuming, draining and grading: what goes over the topic and what is counted of it."""

import json
import os
import signal
import threading
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.cli import main
from millrace.operators.disorder import at_places, drifted, with_slots
from millrace.plans import generate, ledger, models
from millrace.sources import lake
from millrace.sources.plant import DEFAULT, Disorder, Scenario
from millrace.sources.simulator import run_machine
from millrace.streaming import consumer


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    return out, generate.write_run(spark, Scenario(), out, sequence=True)


def test_scans_name_a_work_order_only_at_a_changeover():
    events = [e for m in DEFAULT.machines for e in run_machine(DEFAULT, m, 42, Scenario().start_date, 1)]
    scans = [json.loads(e[6]) for e in events if e[1] == "operator_scan"]
    fields = {(s["action"], tuple(s)) for s in scans}
    plain, full = ("badge_id", "action"), ("badge_id", "action", "work_order")
    assert fields == {("login", plain), ("logout", plain), ("changeover_start", full), ("changeover_end", full)}
    units = [json.loads(e[6]) for e in events if e[1] == "cycle"]
    assert {tuple(u) for u in units} == {("work_order", "sku", "unit_seq", "duration_s", "operator")}


def test_published_messages_keep_their_keys_and_their_damage(spark, run, tmp_path, capsys):
    out, _ = run
    topic, root = str(tmp_path / "topic"), str(tmp_path / "lake")
    for _ in range(2):
        assert main(["publish", f"{out}/events", topic]) == 0
        assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"sent": 4247, "failed": 0}
    sent = spark.read.parquet(topic)
    assert sent.groupBy("partition", "offset").count().where("count > 1").isEmpty()
    assert sent.where("value like '%_raw%'").isEmpty() and sent.where("key is null").isEmpty()
    ends = {r.partition: r.end for r in sent.groupBy("partition").agg((F.max("offset") + 1).alias("end")).collect()}
    assert sum(ends.values()) == 2 * 4247 and {p: n // 2 for p, n in ends.items()} == {1: 372, 3: 2042, 4: 1326, 5: 507}
    before = {r.partition: r.lag for r in consumer.file_topic_lag(spark, topic, root).collect()}
    assert before == ends
    assert main(["consume", topic, root]) == 0
    counts = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (counts["consumed"], counts["rejects"]) == (8494, 8)
    assert lake.read_quarantine(spark, root).count() == 8
    assert lake.read_quarantine(spark, root).where("machine_id is null").isEmpty()
    assert {r.lag for r in consumer.file_topic_lag(spark, topic, root).collect()} == {0}


def test_generated_corruption_reaches_a_topic(spark, tmp_path):
    messages, _ = generate.at_scale(spark, Scenario())
    messages = lake.save_model(messages, str(tmp_path), "messages")
    lake.write_topic(messages, str(tmp_path / "topic"))
    sent = spark.read.parquet(str(tmp_path / "topic"))
    corrupt = messages.where("corrupt_text is not null").count()
    root = str(tmp_path / "lake")
    consumer.start(consumer.file_topic(spark, str(tmp_path / "topic")), root, bounded=True).awaitTermination()
    assert corrupt and lake.read_quarantine(spark, root).count() == corrupt
    assert lake.read_bronze(spark, root).count() + corrupt == sent.count() == messages.count()
    for r in sent.groupBy("partition").agg(F.count("*").alias("n"), F.min("offset").alias("a"), F.max("offset").alias("b")).collect():
        assert (r.a, r.b) == (0, r.n - 1)


def test_counts_outlive_the_reports_that_spark_keeps():
    counts = consumer.Counts()
    for batch in range(250):
        counts.add(batch, 10, 1)
    counts.add(249, 10, 1)  # a retry
    assert counts.total() == {"consumed": 2750, "records": 2500, "rejects": 250, "commits": 250}


def test_lag_of_a_broker_is_a_number_for_each_partition():
    report = {"endOffset": {"shop": {"0": 5, "1": 7}}, "latestOffset": '{"shop": {"0": 9, "1": 7, "2": 3}}'}
    assert consumer.kafka_lag(report) == {"shop": {"0": 4, "1": 0, "2": 3}}
    assert consumer.kafka_lag({"endOffset": None, "latestOffset": None}) == {}


def test_a_signal_stops_the_consumer_after_its_batch(spark, run, tmp_path):
    out, _ = run
    topic, root = str(tmp_path / "topic"), str(tmp_path / "lake")
    lake.publish(spark, f"{out}/events", topic)
    query = consumer.start(consumer.file_topic(spark, topic), root, interval="1 second")
    threading.Timer(0.5, lambda: os.kill(os.getpid(), signal.SIGTERM)).start()
    before = signal.getsignal(signal.SIGTERM)
    consumer.run_until_signal(query)
    assert not query.isActive and query.exception() is None
    assert signal.getsignal(signal.SIGTERM) is before
    consumer.start(consumer.file_topic(spark, topic), root, bounded=True).awaitTermination()
    assert lake.read_bronze(spark, root).count() == 4243
    assert lake.read_bronze(spark, root).select("kafka_partition", "kafka_offset").distinct().count() == 4243


@pytest.mark.parametrize(("share", "third"), [(0.5, None), (0.5, 0.75), (0.0, 0.001), (0.999, 0.5), (1.0, None)])
def test_cutover_is_at_an_index_of_the_event_order(spark, share, third):
    start = datetime(2026, 3, 2, tzinfo=UTC)
    rows = [(f"e{i:04d}", "cycle", f"M{i % 3}", start + timedelta(seconds=(i * 7919) % 9000 // 3), start, 1, '{"operator":"a"}') for i in range(701)]
    names = "event_id string, event_type string, machine_id string, event_time timestamp, publish_time timestamp, schema_version int, payload string"
    events = spark.createDataFrame(rows, names).repartition(3)
    d = Disorder(schema_drift_at=share, schema_v3_at=third)
    order = sorted(rows, key=lambda r: (r[3], r[2], r[0]))
    second, last = int(len(rows) * share), int(len(rows) * third) if third is not None else len(rows)
    want = {r[0]: 3 if i >= max(second, last) else 2 if i >= second else 1 for i, r in enumerate(order)}
    assert {r.event_id: r.schema_version for r in drifted(events, d).collect()} == want
    found = at_places(events, [0, 350, 700])
    assert [f[2] for f in found] == [order[i][0] for i in (0, 350, 700)]


def test_slots_count_each_machine_through(spark):
    start = datetime(2026, 3, 2, tzinfo=UTC)
    rows = [(f"e{i:03d}", f"M{i % 3}", start + timedelta(seconds=(i * 7919) % 20_000)) for i in range(400)]
    got = {r.event_id: r.slot for r in with_slots(spark.createDataFrame(rows, "event_id string, machine_id string, publish_time timestamp")).collect()}
    for machine in ("M0", "M1", "M2"):
        order = sorted((r for r in rows if r[1] == machine), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in order] == list(range(len(order)))


def test_injections_are_summed_up_in_both_modes(spark, run, tmp_path):
    out, injected = run
    assert json.loads(spark.read.text(f"{out}/injections").first().value) == injected
    assert injected["corrupt"] == 4 and spark.read.text(f"{out}/events").count() == 4247
    scale = generate.write_run(spark, Scenario(), str(tmp_path))
    assert scale.keys() == injected.keys() and scale["late"] and scale["duplicate_extra"] >= scale["duplicated"] > 0
    lines = spark.read.text(f"{tmp_path}/events")
    assert lines.where("value like '%\"_raw\"%'").count() >= scale["corrupt"]
    lake.load(spark, f"{tmp_path}/events", f"{tmp_path}/manifest", f"{tmp_path}/lake")
    from millrace.plans.build import build

    made = build(spark, f"{tmp_path}/lake", "2026-03-04 00:00:00")
    assert made["completeness_ledger"].where("status <> 'reconciled'").isEmpty()


def test_strict_ledger_sees_exchanged_ids(spark, run, tmp_path):
    out, _ = run
    lake.load(spark, f"{out}/events", f"{out}/manifest", str(tmp_path))
    slv = models.slv_events(models.stg_events(lake.read_bronze(spark, str(tmp_path))))
    truth = lake.read_manifests(spark, str(tmp_path))
    victim = slv.where("event_type = 'cycle'").orderBy("event_time", "event_id").first()
    forged = slv.withColumn("event_id", F.when(F.col("event_id") == victim.event_id, F.lit("forged")).otherwise(F.col("event_id")))
    broken = {}
    for name, rows in (("true", slv), ("forged", forged)):
        for strict in (False, True):
            agg = models.agg_window_machine(rows, with_ids=strict)
            made = ledger.completeness_ledger(truth, agg, "2026-03-04 00:00:00", strict=strict)
            broken[name, strict] = {(r.machine_id, r.window_start, r.root_cause) for r in made.where("status = 'broken'").collect()}
    assert not broken["true", False] and not broken["true", True] and not broken["forged", False]
    assert broken["forged", True] == {(victim.machine_id, victim.window_start, ledger.CHECKSUM)}


def test_acceptance_and_query_commands(spark, run, tmp_path, capsys):
    out, _ = run
    report, root = str(tmp_path / "report.json"), str(tmp_path / "twice")
    code = main(["acceptance", f"{out}/events", f"{out}/manifest", root, "--out", report, "--as-of", "2026-03-04 00:00:00"])
    with open(report, encoding="utf-8") as f:
        got = json.load(f)
    assert code == 0 and got["identical"] and got["after"]["bronze"] == 4243 and got["failed tests"] == {"before": [], "after": []}
    assert {"load before", "build after", "grade after", "total"} <= got["seconds"].keys()
    capsys.readouterr()
    assert main(["query", f"{root}/first", "select status, count(*) as n from completeness_ledger group by status"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"status": "reconciled", "n": 523}


def test_rewritten_windows_replace_themselves(spark, run, tmp_path):
    out, _ = run
    truth = lake.read_manifest_lines(spark, f"{out}/manifest")
    for part in (truth, truth.where(F.hour("window_start") == 8)):
        lake.write_manifest(part, str(tmp_path))
    back = lake.read_manifests(spark, str(tmp_path))
    assert sorted(back.collect()) == sorted(truth.select(*back.columns).collect())
    days = [d for d in os.listdir(tmp_path / "manifests") if d.startswith("dt=")]
    assert len(days) == truth.select(F.to_date("window_start")).distinct().count()


def test_catalog_tables(spark, run, tmp_path):
    out, _ = run
    lake.load(spark, f"{out}/events", f"{out}/manifest", str(tmp_path))
    names = lake.register_tables(spark, str(tmp_path), "shop")
    assert names == ["shop.bronze", "shop.quarantine", "shop.manifests"]
    assert spark.sql("select count(*) as n from shop.bronze where hr >= '00'").first().n == 4243
    assert spark.table("shop.quarantine").count() == 4 and spark.table("shop.manifests").count() == 523
