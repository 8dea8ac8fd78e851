"""Generator, injector, load, build, streaming: end to end in temporary folders."""

import dataclasses
import json
from collections import Counter
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.data_tests import DataTestFailure
from millrace.operators.disorder import inject, inject_in_sequence, to_version
from millrace.plans import build as b
from millrace.plans import fixture, generate, models
from millrace.plans import ledger as led
from millrace.sources import lake
from millrace.sources.plant import DEFAULT, Disorder, Plant, Scenario
from millrace.sources.simulator import run_machine, simulate
from millrace.streaming import consumer, windows

AS_OF = datetime(2026, 3, 4, tzinfo=UTC)


@pytest.fixture(scope="module")
def clean():
    s = Scenario()
    return [e for m in DEFAULT.machines for e in run_machine(DEFAULT, m, s.seed, s.start_date, s.days)]


def test_published_counts_of_seed_42(clean):
    published, log, canonical = inject_in_sequence(clean, Disorder(), 42)
    assert (len(clean), len(published)) == (4155, 4247)
    assert Counter(e[1] for e in clean)["cycle"] == 3853 and Counter(e[1] for e in clean)["defect"] == 84
    assert log.summary() == {"late": 85, "duplicated": 52, "duplicate_extra": 92, "out_of_order": 140, "corrupt": 4, "skewed_machines": 2}
    assert set(log.skewed) == {"MW1-B-01", "MW1-A-01"} and sum(r["schema_version"] == 2 for r in canonical) == 2078


def test_disorder_off_changes_nothing(clean):
    published, log, canonical = inject_in_sequence(clean, Disorder.off(), 42)
    assert len(published) == len(clean) and not any(log.summary().values()) and all(r["schema_version"] == 1 for r in canonical)


def test_machines_are_independent_and_units_count_up(clean):
    alone = run_machine(DEFAULT, DEFAULT.machines[2], 42, Scenario().start_date, 1)
    assert [e for e in clean if e[2] == DEFAULT.machines[2].id] == alone
    units = {}
    for e in clean:
        if e[1] == "cycle":
            p = json.loads(e[6])
            assert p["unit_seq"] == units.get(p["work_order"], 0) + 1
            units[p["work_order"]] = p["unit_seq"]


def test_configuration_is_checked():
    assert DEFAULT.problems() == []
    bad = dataclasses.replace(DEFAULT, lines={"A": ("X",), "C": ()}, units=(5, 1), badges=())
    assert isinstance(bad, Plant) and len(bad.problems()) >= 6
    with pytest.raises(ValueError):
        Disorder(late_rate=1.5)
    with pytest.raises(ValueError):
        Scenario(days=0)


@pytest.fixture(scope="module")
def day(spark, tmp_path_factory):
    """One simulated day, loaded without a broker."""
    root = str(tmp_path_factory.mktemp("lake"))
    messages, manifest, _ = generate.in_sequence(spark, Scenario())
    ordered = messages.orderBy("place").coalesce(1)
    lake.write_events(ordered, f"{root}/events")
    manifest.write.json(f"{root}/manifest")
    counts = lake.load(spark, f"{root}/events", f"{root}/manifest", root)
    return root, counts


def test_load_counts_and_offsets(spark, day):
    root, counts = day
    assert counts == {"bronze": 4243, "quarantine": 4, "windows": 523}
    both = lake.read_bronze(spark, root).select("kafka_partition", "kafka_offset").union(
        lake.read_quarantine(spark, root).select("kafka_partition", "kafka_offset")
    )
    spread = {r.kafka_partition: (r.n, r.lo, r.hi, r.d) for r in both.groupBy("kafka_partition").agg(
        F.count(F.lit(1)).alias("n"), F.min("kafka_offset").alias("lo"), F.max("kafka_offset").alias("hi"), F.count_distinct("kafka_offset").alias("d")
    ).collect()}
    assert {p: v[0] for p, v in spread.items()} == {1: 372, 3: 2042, 4: 1326, 5: 507}
    assert all(lo == 0 and hi == n - 1 == d - 1 for n, lo, hi, d in spread.values())


def test_build_reconciles_every_window_and_replay_changes_nothing(spark, day):
    root, _ = day
    made = b.build(spark, root, AS_OF)
    assert made["slv_events"].count() == 4151
    assert led.grade(made["completeness_ledger"]).first().asDict() == {"windows": 523, "broken": 0}
    machines = {r.machine_id: (r.windows, r.events) for r in led.per_machine(made["completeness_ledger"]).collect()}
    assert machines["MW1-A-01"] == (62, 498) and machines["MW1-A-04"] == (65, 741) and machines["MW1-B-04"] == (64, 552)
    page = b.render(b.gather(made["completeness_ledger"]))
    assert "every window accounted for" in page and "MW1-B-03" in page
    lake.load(spark, f"{root}/events", None, root)
    assert lake.read_bronze(spark, root).count() == 4243
    assert made["tests"].count() == 25


def test_gate_stops_a_build_that_lost_a_window(spark, day, tmp_path):
    root, _ = day
    lake.write_bronze(lake.read_bronze(spark, root).where("machine_id <> 'MW1-B-02'"), str(tmp_path), "x")
    lake.write_manifest(lake.read_manifests(spark, root), str(tmp_path))
    with pytest.raises(DataTestFailure, match="gate_not_broken: 67"):
        b.build(spark, str(tmp_path), AS_OF)


def test_rebuild_from_nothing_grades_the_same(spark, day, tmp_path):
    root, _ = day
    got = b.acceptance(spark, lambda to: lake.load(spark, f"{root}/events", f"{root}/manifest", to), str(tmp_path), AS_OF)
    assert got["identical"] and got["after"] == {"windows": 523, "broken": 0, "bronze": 4243}


def test_third_contract_version_keeps_durations(spark, tmp_path):
    scenario = Scenario(disorder=dataclasses.replace(Disorder(), schema_v3_at=0.75))
    messages, manifest, _ = generate.in_sequence(spark, scenario)
    lake.write_events(messages, f"{tmp_path}/events")
    manifest.write.json(f"{tmp_path}/manifest")
    lake.load(spark, f"{tmp_path}/events", f"{tmp_path}/manifest", str(tmp_path))
    made = b.build(spark, str(tmp_path), AS_OF)
    mean = {r.schema_version: r.m for r in made["fct_cycles"].groupBy("schema_version").agg(F.avg("duration_s").alias("m")).collect()}
    assert set(mean) == {1, 2, 3} and 0.5 < mean[3] / mean[1] < 2


def test_column_injector(spark):
    events = simulate(spark, Scenario()).persist()
    d = Disorder(corrupt_rate=0.01)
    canonical, published = inject(events, d, 42)
    c, p = canonical.persist(), published.persist()
    n = events.count()
    assert c.count() == n and abs(c.where("is_late").count() / n - d.late_rate) < 0.01
    extra = c.agg(F.sum("duplicate_extra")).first()[0]
    assert p.count() == n + extra and 0.005 < c.where("duplicate_extra > 0").count() / n < 0.02
    assert c.where("is_corrupt").count() > 0 and p.where("corrupt_text is not null and not is_corrupt").count() == 0
    moved = c.select("event_id", F.col("event_time").alias("t")).join(events, "event_id").where("t <> event_time").select("machine_id").distinct().count()
    assert moved == d.skewed_machines
    cut = c.groupBy("schema_version").agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi")).orderBy("schema_version").collect()
    assert [r.schema_version for r in cut] == [1, 2] and cut[0].hi <= cut[1].lo
    slots = p.where("copy = 0").groupBy("machine_id").agg(F.count_distinct("slot").alias("d"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.d == r.n for r in slots) and 0.01 < p.where("is_reordered and copy = 0").count() / n < 0.03
    again = inject(events.repartition(5), d, 42)[1]
    assert again.exceptAll(p).count() == 0
    # the third version in columns is what the row form makes
    v3 = inject(events, dataclasses.replace(Disorder.off(), schema_drift_at=0.0, schema_v3_at=0.5), 1)[0]
    old = {r.event_id: r for r in events.collect()}
    for r in v3.orderBy("event_id").limit(300).collect():
        want = to_version(json.loads(old[r.event_id].payload), r.event_type, r.schema_version)
        assert json.loads(r.payload) == want


def topic(spark, sf_dir, path, files=4):
    messages = fixture.messages(fixture.canonical(fixture.events_table(spark, sf_dir)))
    lake.write_topic(messages.repartition(files), path)
    return messages


def test_consumer_restarts_after_a_crash_without_loss_or_copies(spark, sf_dir, tmp_path):
    messages = topic(spark, sf_dir, f"{tmp_path}/topic")
    root = f"{tmp_path}/lake"
    stream = lambda: consumer.file_topic(spark, f"{tmp_path}/topic", max_files=1)
    tries = []

    def crash(batch_id):
        tries.append(batch_id)
        if batch_id == 1 and tries.count(1) == 1:
            raise RuntimeError("killed between the two writes")

    with pytest.raises(Exception, match="killed"):
        consumer.start(stream(), root, bounded=True, fail=crash).awaitTermination()
    query = consumer.start(stream(), root, bounded=True, fail=crash)
    query.awaitTermination()
    landed = lake.read_bronze(spark, root)
    expected = fixture.bronze(fixture.canonical(fixture.events_table(spark, sf_dir)))
    same = ["event_id", "kafka_partition", "kafka_offset", "payload"]
    assert landed.select(same).exceptAll(expected.select(same)).count() == 0
    assert landed.count() == expected.count() and tries.count(1) == 2
    assert lake.read_quarantine(spark, root).count() == messages.count() - landed.count() > 0
    rerun = consumer.start(stream(), root, bounded=True)
    rerun.awaitTermination()
    assert consumer.stats(rerun)["consumed"] == 0 and consumer.lag(query) is not None
    replay = consumer.start(stream(), f"{tmp_path}/other", group="again", bounded=True)
    replay.awaitTermination()
    assert lake.read_bronze(spark, f"{tmp_path}/other").count() == landed.count()


def test_stream_windows_equal_batch_windows(spark, sf_dir, tmp_path):
    events = fixture.canonical(fixture.events_table(spark, sf_dir))
    keep = ["event_id", "machine_id", "event_type", "event_time", "duration_s"]
    events.select(keep).repartition(3).write.parquet(f"{tmp_path}/e")
    events.select(keep).where("i % 7 = 0" if "i" in keep else "event_id % 7 = 0").write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.select(keep).schema).parquet(f"{tmp_path}/e")
    counted = windows.run_to_files(windows.window_counts(windows.deduplicated(stream, "60 days"), None), ["machine_id", "window_start"])
    batch = models.agg_window_machine(
        models.slv_events(models.stg_events(fixture.bronze(events.withColumn("is_corrupt", F.lit(False)))))
    ).select(counted.columns)
    assert counted.exceptAll(batch).count() == 0 and batch.count() == counted.count()


def test_expiry_spares_manifests(spark, day, tmp_path):
    root, _ = day
    rows = lake.read_bronze(spark, root).limit(10)
    lake.write_bronze(rows.withColumn("dt", F.lit("2026-01-01")), str(tmp_path), "a")
    lake.write_bronze(rows.withColumn("dt", F.lit("2026-02-01")), str(tmp_path), "b")
    assert lake.expire(spark, str(tmp_path), "2026-01-15") == ["bronze/dt=2026-01-01"]
    assert lake.read_bronze(spark, str(tmp_path)).count() == 10
