"""Versioned event contracts: declarative rules compiled to Columns, and compatibility of versions.

The contracts of this module are its defaults; read_folder() reads others from JSON Schema files, so a new version needs
a file and no code. A message is parsed once, each field is taken out of it once with its type, and a rule that several
versions share is evaluated once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schemas import EVENT_TYPES

#: Fixed values of the contract.
TOP_LEVEL = ("event_id", "event_type", "machine_id", "event_time", "publish_time", "schema_version", "payload")
MACHINE_PATTERN = "^MW1-[AB]-0[1-4]$"
_TEXTS = ("event_id", "machine_id", "event_time", "publish_time")


@dataclass(frozen=True)
class Field:
    """A payload field: JSON type (string, integer, number) and an optional bound."""

    kind: str
    required: bool = True
    least: float | None = None
    above: float | None = None


@dataclass(frozen=True)
class Contract:
    version: int
    cycle: dict[str, Field] = field(default_factory=dict)
    machines: str = MACHINE_PATTERN
    kinds: tuple[str, ...] = EVENT_TYPES


_COMMON = {"work_order": Field("string"), "sku": Field("string"), "unit_seq": Field("integer", least=0)}
_BADGE = {"operator_badge": Field("string"), "line_id": Field("string", required=False)}
_SECONDS = {"duration_s": Field("number", above=0)}
CONTRACTS = {
    1: Contract(1, _COMMON | _SECONDS | {"operator": Field("string")}),
    2: Contract(2, _COMMON | _SECONDS | _BADGE),
    3: Contract(3, _COMMON | _BADGE | {"duration_ms": Field("integer", above=0)}),
}

#: Changes that no rule of a contract can see.
SEMANTIC_CHANGES = (
    "Seconds sent as milliseconds under the same name: valid in every version, wrong by a thousand.",
    "A state that comes to mean something else under the same name: valid, and every sum over it moves.",
    "Local time sent as UTC: valid, and every event lands in another window.",
)


def to_schema(contract: Contract) -> dict:
    """The contract as a JSON Schema document."""

    def rule(f: Field) -> dict:
        bounds = {"minimum": f.least, "exclusiveMinimum": f.above}
        return {"type": f.kind} | {k: v for k, v in bounds.items() if v is not None}

    payload = {
        "type": "object",
        "required": [k for k, f in contract.cycle.items() if f.required],
        "properties": {k: rule(f) for k, f in contract.cycle.items()},
    }
    properties: dict = {k: {"type": "string"} for k in _TEXTS}
    properties["machine_id"]["pattern"] = contract.machines
    properties |= {"event_type": {"enum": list(contract.kinds)}, "schema_version": {"const": contract.version}, "payload": {"type": "object"}}
    return {
        "type": "object",
        "required": list(TOP_LEVEL),
        "additionalProperties": False,
        "properties": {k: properties[k] for k in TOP_LEVEL},
        "allOf": [{"if": {"properties": {"event_type": {"const": "cycle"}}}, "then": {"properties": {"payload": payload}}}],
    }


def from_schema(schema: dict) -> Contract:
    """A contract from a JSON Schema document of the shape that to_schema() writes; anything else in it is a ValueError."""
    top = schema.get("properties", {})
    version = top.get("schema_version", {}).get("const")
    if not isinstance(version, int) or sorted(schema.get("required", [])) != sorted(TOP_LEVEL) or sorted(top) != sorted(TOP_LEVEL):
        raise ValueError("not the schema of an event contract")
    rules: dict[str, Field] = {}
    for part in schema.get("allOf", []):
        if part.get("if", {}).get("properties", {}).get("event_type", {}).get("const") != "cycle":
            raise ValueError(f"version {version}: a condition on other events than cycle")
        payload = part["then"]["properties"]["payload"]
        for name, rule in payload.get("properties", {}).items():
            unknown = rule.keys() - {"type", "minimum", "exclusiveMinimum", "description", "title", "format"}
            if unknown or rule.get("type") not in ("string", "integer", "number"):
                raise ValueError(f"version {version}: {name} has a rule that is not known: {sorted(unknown) or rule.get('type')}")
            rules[name] = Field(rule["type"], name in payload.get("required", []), rule.get("minimum"), rule.get("exclusiveMinimum"))
    return Contract(
        version, rules, top["machine_id"].get("pattern", MACHINE_PATTERN), tuple(top["event_type"].get("enum", EVENT_TYPES))
    )


def read_folder(folder: str) -> dict[int, Contract]:
    """The contracts of a folder's *.json files, by version."""
    found = [from_schema(json.loads(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.json"))]
    if len({c.version for c in found}) < len(found):
        raise ValueError(f"{folder}: a version has two files")
    return {c.version: c for c in found}


def load(version: int, contracts: dict[int, Contract] | None = None) -> Contract:
    known = CONTRACTS if contracts is None else contracts
    if version not in known:
        raise ValueError(f"no contract of version {version}")
    return known[version]


def _paths(contracts: dict[int, Contract]) -> list[str]:
    """Everything that a rule looks at, payload fields after a dot."""
    inner = dict.fromkeys(f"payload.{name}" for c in contracts.values() for name in c.cycle)
    return [*TOP_LEVEL, *inner]


class _Looked:
    """What the rules ask about one message, as Columns: all facts that facts() names."""

    def __init__(self, keys: Column, found: dict[str, Column]):
        self.keys, self.found = keys, found

    def has(self, path: str) -> Column:
        return self.found[f"has {path}"]

    def text(self, path: str) -> Column:
        return self.found[f"text {path}"]

    def number(self, path: str) -> Column:
        return self.found[f"value {path}"]

    def is_a(self, path: str, kind: str) -> Column:
        return self.found[f"{kind} {path}"]


def _facts(contracts: dict[int, Contract], values: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """The facts that rules ask for, from each path's variant value and the name of its JSON type."""
    kinds = {("schema_version", "number"), ("payload", "object"), *((k, "string") for k in _TEXTS)}
    kinds |= {(f"payload.{name}", f.kind) for c in contracts.values() for name, f in c.cycle.items()}
    out = {f"has {path}": value.isNotNull() for path, (value, _) in values.items()}
    for path in ("event_type", "machine_id"):
        out[f"text {path}"] = F.try_variant_get(values[path][0], "$", "string")
    for path, kind in sorted(kinds):
        value, name = values[path]
        number = F.try_variant_get(value, "$", "double")
        if kind == "string":
            right = name == "STRING"
        elif kind == "object":
            right = F.startswith(name, F.lit("OBJECT"))
        else:  # a boolean is no number, and 3.0 is an integer
            out[f"value {path}"] = number
            right = F.substring_index(name, "(", 1).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT")
        if kind == "integer":
            right = right & (number == F.floor(number))
        out[f"{kind} {path}"] = F.coalesce(right, F.lit(False))
    return out


def _errors(look: _Looked, contracts: dict[int, Contract], version: int | None) -> Column:
    def says(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(text))

    declared, kind = look.number("schema_version"), look.text("event_type")

    def under(versions: list[int]) -> Column:
        """The message is judged by one of these versions."""
        return F.lit(version in versions) if version is not None else F.coalesce(declared.isin(*map(float, versions)), F.lit(False))

    def alike(rule_of) -> list[tuple]:
        """(rule, versions that share it)"""
        out: dict = {}
        for v, c in contracts.items():
            out.setdefault(rule_of(c), []).append(v)
        return list(out.items())

    checks = [says(~look.has(k), f"<root>: '{k}' is a required property") for k in TOP_LEVEL]
    extra = F.array_except(look.keys, F.array(*[F.lit(k) for k in TOP_LEVEL]))
    checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("<root>: additional properties "), F.array_join(extra, ", "))))
    checks += [says(look.has(k) & ~look.is_a(k, "string"), f"{k}: not of type string") for k in _TEXTS]
    unknown = ~under(list(contracts))
    for (kinds, machines), versions in alike(lambda c: (c.kinds, c.machines)):
        here = under(versions) | unknown
        checks.append(says(here & look.has("event_type") & ~F.coalesce(kind.isin(*kinds), F.lit(False)), "event_type: not one of the enum"))
        checks.append(says(here & ~look.text("machine_id").rlike(machines), "machine_id: does not match the pattern"))
    checks.append(says(look.has("payload") & ~look.is_a("payload", "object"), "payload: not of type object"))
    checks.append(says(unknown & look.has("schema_version"), "schema_version: unknown version"))
    if version is not None:
        other = look.has("schema_version") & ~F.coalesce(declared == version, F.lit(False))
        checks.append(says(under([version]) & other, f"schema_version: {version} was expected"))
    cycle = F.coalesce(kind == "cycle", ~look.has("event_type")) & look.is_a("payload", "object")
    for path in _paths(contracts)[len(TOP_LEVEL) :]:
        name = path.split(".", 1)[1]
        for f, versions in alike(lambda c: c.cycle.get(name)):  # noqa: B023
            if f is None:
                continue
            here, right = under(versions) & cycle, look.is_a(path, f.kind)
            number = F.lit(None) if f.kind == "string" else look.number(path)
            bad = F.when(look.has(path) & ~right, F.lit(f"{path}: not of type {f.kind}"))
            if f.required:
                bad = bad.when(~look.has(path), F.lit(f"payload: '{name}' is a required property"))
            if f.least is not None:
                bad = bad.when(right & (number < f.least), F.lit(f"{path}: less than the minimum of {f.least:g}"))
            if f.above is not None:
                bad = bad.when(right & (number <= f.above), F.lit(f"{path}: not above {f.above:g}"))
            checks.append(F.when(here, bad))
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*checks))))


def _value(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, f"$.{path}", "variant")


def contract_errors(value: Column, version: int | None = None, contracts: dict[int, Contract] | None = None) -> Column:
    """Sorted array of messages for one message's JSON text; empty if it meets the contract.

    Without `version` the declared one applies; an unknown one is an error by itself. Formats are notes
    only, and payloads of other event types than cycle are free. For many messages, validate() is the faster way.
    """
    contracts = CONTRACTS if contracts is None else contracts
    variant = F.try_parse_json(value)
    values = {p: (_value(variant, p), F.schema_of_variant(_value(variant, p))) for p in _paths(contracts)}
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    return _errors(_Looked(keys, _facts(contracts, values)), contracts, version)


def validate(messages: DataFrame, version: int | None = None, contracts: dict[int, Contract] | None = None) -> DataFrame:
    """messages(value) with `errors`; text that is no JSON object is left out, as corrupt."""
    contracts = CONTRACTS if contracts is None else contracts
    paths, own = _paths(contracts), messages.columns
    # in steps, so that each is worked out once: the text, its fields, their types
    parsed = messages.select("*", F.json_object_keys("value").alias("__keys"), F.try_parse_json("value").alias("__variant"))
    objects = parsed.where(F.col("__keys").isNotNull() & F.col("__variant").isNotNull() & ~F.array_contains("__keys", "_raw"))
    split = objects.select(*own, "__keys", *[_value(F.col("__variant"), p).alias(f"__v{i}") for i, p in enumerate(paths)])
    typed = split.select("*", *[F.schema_of_variant(f"__v{i}").alias(f"__t{i}") for i in range(len(paths))])
    facts = _facts(contracts, {p: (F.col(f"__v{i}"), F.col(f"__t{i}")) for i, p in enumerate(paths)})
    told = typed.select(*own, "__keys", *[fact.alias(f"__f{i}") for i, fact in enumerate(facts.values())])
    look = _Looked(F.col("__keys"), {name: F.col(f"__f{i}") for i, name in enumerate(facts)})
    return told.select(*own, _errors(look, contracts, version).alias("errors"))


def contract_check(messages: DataFrame, examples: int = 3, contracts: dict[int, Contract] | None = None) -> dict:
    """What a producer's gate needs: counts by declared version, the corrupt ones skipped, failures."""
    total = messages.count()
    checked = validate(messages, contracts=contracts).withColumn("v", F.get_json_object("value", "$.schema_version").try_cast("int"))
    by = checked.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") > 0).alias("bad")).collect()
    n = sum(r.n for r in by)
    failures = [r.errors[0] for r in checked.where(F.size("errors") > 0).select("errors").limit(examples).collect()]
    return {
        "checked": n,
        "corrupt_skipped": total - n,
        "by_schema_version": {r.v: r.n for r in sorted(by, key=lambda r: (r.v is None, r.v))},
        "failures": failures,
        "ok": sum(r.bad for r in by) == 0,
    }


@dataclass(frozen=True)
class Diff:
    added: tuple[str, ...]
    removed: tuple[str, ...]
    changed: tuple[str, ...]
    breaks_backward: tuple[str, ...]
    breaks_forward: tuple[str, ...]

    @property
    def compatibility(self) -> str:
        if self.breaks_backward and self.breaks_forward:
            return "NONE"
        if self.breaks_forward:
            return "BACKWARD"
        return "FORWARD" if self.breaks_backward else "FULL"


def compare(old: int, new: int, contracts: dict[int, Contract] | None = None) -> Diff:
    """Added required fields break readers of old data; removed required ones break old readers; a type change both."""
    a, b = load(old, contracts).cycle, load(new, contracts).cycle
    added, removed = sorted(b.keys() - a.keys()), sorted(a.keys() - b.keys())
    changed = [k for k in sorted(a.keys() & b.keys()) if a[k].kind != b[k].kind]
    return Diff(
        tuple(added),
        tuple(removed),
        tuple(changed),
        tuple([k for k in added if b[k].required] + changed),
        tuple([k for k in removed if a[k].required] + changed),
    )


def report(contracts: dict[int, Contract] | None = None) -> str:
    known = sorted(CONTRACTS if contracts is None else contracts)
    lines = ["from  to  compatibility  added / removed / changed"]
    for old, new in zip(known, known[1:], strict=False):
        d = compare(old, new, contracts)
        lines.append(f"v{old}    v{new}  {d.compatibility:<13}  {', '.join(d.added) or '-'} / {', '.join(d.removed) or '-'} / {', '.join(d.changed) or '-'}")
    return "\n".join([*lines, "", "Not visible to any rule:", *[f"- {s}" for s in SEMANTIC_CHANGES]])
