"""One build of the lakehouse: models in order, data tests, gate, and the status page over the ledger."""

from __future__ import annotations

import html
import time

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import data_tests
from millrace.plans import ledger as led
from millrace.plans import models
from millrace.sources import lake


def build(spark: SparkSession, root: str, as_of=None, strict: bool = False, gate: bool = True) -> dict[str, DataFrame]:
    """Staging stays a view; silver is written once and read by its four consumers; the gate raises on broken windows."""
    slv = lake.save_model(models.slv_events(models.stg_events(lake.read_bronze(spark, root))), root, "slv_events")
    made = {
        "slv_events": slv,
        "agg_window_machine": lake.save_model(models.agg_window_machine(slv, with_ids=strict), root, "agg_window_machine"),
        "dim_machine": lake.save_model(models.dim_machine(slv), root, "dim_machine"),
        "fct_cycles": lake.save_model(models.fct_cycles(slv), root, "fct_cycles"),
        "fct_defects": lake.save_model(models.fct_defects(slv), root, "fct_defects"),
    }
    rows = led.completeness_ledger(lake.read_manifests(spark, root), made["agg_window_machine"], as_of, strict=strict)
    made["completeness_ledger"] = lake.save_model(rows, root, "completeness_ledger")
    made["tests"] = data_tests.lakehouse_suite(
        slv, made["dim_machine"], made["fct_cycles"], made["fct_defects"], made["completeness_ledger"], made["agg_window_machine"]
    )
    if gate:
        data_tests.enforce(made["tests"])
    return made


def gather(ledger: DataFrame) -> dict:
    """What the status page shows: a handful of aggregates and two short lists."""
    dicts = lambda df: [r.asDict() for r in df.collect()]
    return {
        "by_status": {r["status"]: r["n"] for r in dicts(led.status_counts(ledger))},
        "totals": dicts(led.ledger_totals(ledger))[0],
        "per_machine": dicts(led.per_machine(ledger)),
        "broken": dicts(led.broken_windows(ledger)),
        "recent": dicts(led.recent_windows(ledger)),
    }


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', r.values())}</tr>" for r in rows)
    return f"<table><tr>{cells('th', rows[0])}</tr>{body}</table>"


def render(data: dict) -> str:
    """A static page; whoever serves it should treat any broken window as a failure."""
    broken = data["by_status"].get("broken", 0)
    verdict = f"{broken} broken windows" if broken else "every window accounted for"
    parts = [f"<h1>{verdict}</h1>", _table([data["by_status"]] if data["by_status"] else []), _table([data["totals"]])]
    for title, key in (("Machines", "per_machine"), ("Broken", "broken"), ("Recent", "recent")):
        parts.append(f"<h2>{title}</h2>{_table(data[key])}")
    style = "<style>body{font-family:sans-serif}td,th{padding:2px 8px;text-align:left}</style>"
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Completeness</title>{style}{"".join(parts)}</html>'


def acceptance(spark: SparkSession, load, root: str, as_of=None) -> dict:
    """Load and grade, then rebuild from nothing by `load(root)` and grade again: both grades must be the same.

    The report has the seconds of each step and the models' row counts beside the grades.
    """
    report: dict = {"seconds": {}, "failed tests": {}}

    def timed(step: str, run):
        began = time.perf_counter()
        out = run()
        report["seconds"][step] = round(time.perf_counter() - began, 3)
        return out

    for when in ("before", "after"):
        where = f"{root}/{'first' if when == 'before' else 'second'}"
        timed(f"load {when}", lambda: load(where))  # noqa: B023
        made = timed(f"build {when}", lambda: build(spark, where, as_of, gate=False))  # noqa: B023
        grade = timed(f"grade {when}", lambda: led.grade(made["completeness_ledger"]).first().asDict())  # noqa: B023
        report["failed tests"][when] = [r.test for r in made["tests"].where("failures > 0").collect()]
        report[when] = grade | {"bronze": lake.read_bronze(spark, where).count()}
    report["seconds"]["total"] = round(sum(report["seconds"].values()), 3)
    return report | {"identical": report["before"] == report["after"]}
