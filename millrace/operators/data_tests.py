"""Declarative data tests. A test gives the failing rows; a suite counts them and can stop a build.

Column tests (not null, accepted values, expressions) of one table share a single scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once (nulls aside)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def relationships(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of the child whose non-null key has no parent."""
    keys = parent.select(F.col(key).alias("__key")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")


def expression_is_true(df: DataFrame, expression: str | Column) -> DataFrame:
    e = F.expr(expression) if isinstance(expression, str) else expression
    return df.where(~F.coalesce(e, F.lit(False)))


@dataclass(frozen=True)
class ColumnTest:
    name: str
    fails: Column

    @staticmethod
    def not_null(column: str) -> ColumnTest:
        return ColumnTest(f"not_null_{column}", F.col(column).isNull())

    @staticmethod
    def accepted(column: str, values: Iterable) -> ColumnTest:
        return ColumnTest(f"accepted_values_{column}", F.col(column).isNotNull() & ~F.col(column).isin(*values))

    @staticmethod
    def holds(name: str, expression: str) -> ColumnTest:
        return ColumnTest(name, ~F.coalesce(F.expr(expression), F.lit(False)))


def column_tests(df: DataFrame, table: str, tests: list[ColumnTest]) -> DataFrame:
    """test, failures: all column tests of a table in one scan."""
    counts = df.agg(*[F.count_if(t.fails).alias(t.name) for t in tests])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(f"{table}.{t.name}").alias("test"), F.col(t.name).alias("failures")) for t in tests])).alias("r")
    ).select("r.test", "r.failures")


def failing(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("test"), "failures")


def lakehouse_suite(slv: DataFrame, dim: DataFrame, cycles: DataFrame, defects: DataFrame, ledger: DataFrame, agg: DataFrame) -> DataFrame:
    """The 25 tests of the models: test, failures."""
    from millrace.schemas import EVENT_TYPES, SCHEMA_VERSIONS, STATUSES

    nn, ok = ColumnTest.not_null, ColumnTest.accepted
    parts = [
        failing("slv_events.unique_event_id", unique(slv, "event_id")),
        failing("dim_machine.unique_machine_id", unique(dim, "machine_id")),
        failing("fct_cycles.unique_cycle_key", unique(cycles, "cycle_key")),
        failing("fct_defects.unique_defect_key", unique(defects, "defect_key")),
        column_tests(
            slv,
            "slv_events",
            [nn(c) for c in ("event_id", "event_type", "machine_id", "event_time", "schema_version", "window_start")]
            + [ok("event_type", EVENT_TYPES), ok("schema_version", SCHEMA_VERSIONS)],
        ),
        column_tests(dim, "dim_machine", [nn("machine_id")]),
        column_tests(cycles, "fct_cycles", [nn("cycle_key"), nn("machine_id")]),
        column_tests(defects, "fct_defects", [nn("defect_key")]),
        column_tests(agg, "agg_window_machine", [nn("machine_id"), nn("window_start")]),
        column_tests(
            ledger,
            "completeness_ledger",
            [nn("machine_id"), nn("window_start"), nn("status"), ok("status", STATUSES), ColumnTest.holds("gate_not_broken", "status <> 'broken'")],
        ),
        failing("fct_cycles.relationships_machine_id", relationships(cycles, "machine_id", dim, "machine_id")),
        failing("fct_defects.relationships_machine_id", relationships(defects, "machine_id", dim, "machine_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


class DataTestFailure(RuntimeError):
    pass


def enforce(results: DataFrame) -> None:
    """Raise if any test has failures; the results are one row per test."""
    failed = results.where("failures > 0").orderBy("test").collect()
    if failed:
        raise DataTestFailure(", ".join(f"{r.test}: {r.failures}" for r in failed))
