"""Contracts: messages made from the rules themselves meet them, and one broken rule at a time is reported."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import contracts as c

#: A value of each JSON type, and values that are not of it.
GOOD = {"string": "text of some kind", "integer": 12, "number": 0.75}
BAD = {"string": [5, None, ["x"]], "integer": [1.5, True, "12", None], "number": ["0.75", False, {}]}


def message(version, kind="cycle"):
    payload = {name: GOOD[f.kind] for name, f in c.CONTRACTS[version].cycle.items()}
    top = {k: f"some {k}" for k in c.TOP_LEVEL}
    return top | {"machine_id": "MW1-B-03", "event_type": kind, "schema_version": version, "payload": payload}


def changed(value, path, to=...):
    """value with the field at path set, or taken out."""
    out = copy.deepcopy(value)
    *outer, last = path.split(".")
    place = out[outer[0]] if outer else out
    if to is ...:
        place.pop(last)
    else:
        place[last] = to
    return out


def found(spark, cases, by_column):
    """The errors of each of (value, version), by the Column form or by validate()."""
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(cases)]
    df, out = spark.createDataFrame(rows, "i int, value string"), {}
    for version in {v for _, v in cases}:
        if by_column:
            got = df.select("i", c.contract_errors(F.col("value"), version).alias("errors"))
        else:
            got = c.validate(df, version).select("i", "errors")
        out |= {(r.i, version): r.errors for r in got.collect()}
    return [out[i, v] for i, (_, v) in enumerate(cases)]


def broken_cases():
    """(value, version, what the report must say) for every rule of every contract."""
    for v, contract in c.CONTRACTS.items():
        whole = message(v)
        for k in c.TOP_LEVEL:
            yield changed(whole, k), None, f"'{k}' is a required"
        for k in ("event_id", "machine_id", "event_time", "publish_time"):
            yield changed(whole, k, 5), None, f"{k}: not of type string"
        yield changed(whole, "event_type", "something else"), None, "event_type: not one"
        yield changed(whole, "machine_id", "MW1-C-03"), None, "machine_id: does not match"
        yield changed(whole, "payload", [1]), None, "payload: not of type object"
        yield changed(whole, "more", 1), None, "additional properties more"
        yield whole, v % 3 + 1, f"schema_version: {v % 3 + 1} was expected"
        for name, f in contract.cycle.items():
            for wrong in BAD[f.kind]:
                yield changed(whole, f"payload.{name}", wrong), None, f"payload.{name}: not of type {f.kind}"
            if f.required:
                yield changed(whole, f"payload.{name}"), None, f"'{name}' is a required"
            if f.least is not None:
                yield changed(whole, f"payload.{name}", f.least - 1), None, "less than the minimum"
            if f.above is not None:
                yield changed(whole, f"payload.{name}", f.above), None, "not above"
    yield changed(message(1), "schema_version", 99), None, "unknown version"


def sound_cases():
    for v, contract in c.CONTRACTS.items():
        yield message(v), None
        yield message(v), v
        for name, f in contract.cycle.items():
            yield changed(message(v, "defect"), f"payload.{name}", {"any": "thing"}), None
            if not f.required:
                yield changed(message(v), f"payload.{name}"), None
            if f.kind == "integer":
                yield changed(message(v), f"payload.{name}", 3.0), None
            if f.kind != "string":
                yield changed(message(v), f"payload.{name}", 64200), None  # a unit that changed is not seen


@pytest.mark.parametrize("by_column", [False, True])
def test_every_rule(spark, by_column):
    broken, sound = list(broken_cases()), list(sound_cases())
    for (value, version, says), errors in zip(broken, found(spark, [b[:2] for b in broken], by_column), strict=True):
        assert any(says in e for e in errors), (value, version, errors)
    for case, errors in zip(sound, found(spark, sound, by_column), strict=True):
        assert errors == [], case


def test_check_counts_by_declared_version(spark):
    good = [message(1), message(2), changed(message(2), "machine_id", "x")]
    lines = [*map(json.dumps, good), "{", '{"_key":"k","_raw":"{"}', "[]", "null", ""]
    got = c.contract_check(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert (got["checked"], got["corrupt_skipped"], got["by_schema_version"], got["ok"]) == (3, 5, {1: 1, 2: 2}, False)
    assert len(got["failures"]) == 1
    none = c.contract_check(spark.createDataFrame([], "value string"))
    assert (none["checked"], none["ok"]) == (0, True)


def test_compatibility():
    assert c.compare(1, 2).compatibility == c.compare(2, 3).compatibility == "NONE"
    assert c.compare(1, 1).compatibility == "FULL" and c.compare(1, 2).added == ("line_id", "operator_badge")
    base = {"a": c.Field("string")}
    cases = {
        "FULL": base | {"b": c.Field("string", required=False)},
        "FORWARD": base | {"b": c.Field("string")},
        "BACKWARD": {},
        "NONE": {"a": c.Field("integer")},
    }
    for want, cycle in cases.items():
        pair = {1: c.Contract(1, base), 2: c.Contract(2, cycle)}
        assert c.compare(1, 2, pair).compatibility == want
    with pytest.raises(ValueError):
        c.load(4)
    assert "v1    v2  NONE" in c.report()


def test_a_new_version_is_a_file(spark, tmp_path):
    for v, contract in c.CONTRACTS.items():
        assert c.from_schema(c.to_schema(contract)) == contract
        (tmp_path / f"v{v}.json").write_text(json.dumps(c.to_schema(contract)))
    fourth = c.Contract(4, c.CONTRACTS[3].cycle | {"tool": c.Field("string")}, "^NEW-[0-9]$")
    (tmp_path / "four.json").write_text(json.dumps(c.to_schema(fourth)))
    known = c.read_folder(str(tmp_path))
    assert sorted(known) == [1, 2, 3, 4] and "v3    v4  FORWARD" in c.report(known)
    value = changed(changed(message(3), "schema_version", 4), "machine_id", "NEW-1")
    rows = [(json.dumps(v),) for v in (value, changed(value, "payload.tool", "drill"), message(3))]
    got = c.validate(spark.createDataFrame(rows, "value string"), contracts=known).collect()
    assert [r.errors for r in got] == [["payload: 'tool' is a required property"], [], []]
    (tmp_path / "again.json").write_text(json.dumps(c.to_schema(fourth)))
    for bad in (lambda: c.read_folder(str(tmp_path)), lambda: c.from_schema({"type": "object"})):
        with pytest.raises(ValueError):
            bad()
