"""The disorder injector: skew, drift, lateness, reordering, duplicates and corruption, all logged.

Two modes. `inject` works in Column expressions with draws that depend on the seed and the event, so it
is order-free and runs at any size. `inject_in_sequence` makes its draws one after another over the ordered
stream, on the driver: it exists to reproduce published runs of one seed, and only for streams of
that size. In both, ground truth is taken after the record itself changed (skew, drift) and before transport
(late, reordered, duplicated, corrupt).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.exprs import draw
from millrace.sources.plant import Disorder
from millrace.sources.simulator import seeded

#: What is left of a corrupted message.
TRUNCATIONS = ('{"event_id": "', '{"event_id": "abc", "event_type": "cyc', '{"machine_id": ', "{", "")
DUPLICATE_LAG_MS = (5, 900)
WANDER = 0.1


def to_version(payload: dict, kind: str, version: int) -> dict:
    """A version 1 payload as version 2 or 3."""
    if version < 2:
        return payload
    out = dict(payload)
    if kind == "cycle" and "operator" in out:
        out["operator_badge"] = out.pop("operator")
    out.setdefault("line_id", "")
    if version >= 3 and kind == "cycle" and "duration_s" in out:
        out["duration_ms"] = int(round(out.pop("duration_s") * 1000))
    return out


def versioned_payload(version, kind, payload):
    """Column form of to_version: version 2 renames and adds, version 3 changes the unit too."""
    inner = F.substring(payload, 2, F.length(payload) - 2)
    v2 = F.when(
        kind == "cycle", F.regexp_replace(inner, '"operator":', '"operator_badge":')
    ).otherwise(inner)
    v2 = F.concat(F.lit("{"), v2, F.when(inner == "", F.lit("")).otherwise(F.lit(",")), F.lit('"line_id":""}'))
    ms = F.rint(F.get_json_object(payload, "$.duration_s").cast("double") * 1000).cast("long").cast("string")
    v3 = F.when(
        (kind == "cycle") & ms.isNotNull(),
        F.regexp_replace(v2, F.lit('"duration_s":[^,}]*'), F.concat(F.lit('"duration_ms":'), ms)),
    ).otherwise(v2)
    return F.when(version >= 3, v3).when(version == 2, v2).otherwise(payload)


def skewed(events: DataFrame, d: Disorder, seed: int) -> DataFrame:
    """Moves event_time on the chosen machines: a fixed offset and a wander about it. Publishing is not moved."""
    if not d.skewed_machines or not d.skew_max_seconds:
        return events
    chosen = (
        events.select("machine_id").distinct().orderBy(draw(seed, "skew", "machine_id"), "machine_id").limit(d.skewed_machines)
    ).select("machine_id", ((2 * draw(seed, "offset", "machine_id") - 1) * d.skew_max_seconds).alias("offset_s"))
    wander = (2 * draw(seed, "wander", "event_id") - 1) * WANDER * d.skew_max_seconds
    moved = F.timestamp_micros(F.unix_micros("event_time") + F.round((F.col("offset_s") + wander) * 1e6).cast("long"))
    return (
        events.join(F.broadcast(chosen), "machine_id", "left")  # at most skewed_machines rows
        .withColumn("event_time", F.when(F.col("offset_s").isNotNull(), moved).otherwise(F.col("event_time")))
        .select(*events.columns)
    )


def at_places(events: DataFrame, places: list[int]) -> list[tuple[int, str, str]]:
    """(microseconds, machine_id, event_id) of the events at `places` (from 0) of the order by event_time and these two.

    Events are counted by hour, then by second in an hour that holds a place; only the events of that second
    are ever put in order. So what reaches the driver are a number for each hour, and 3,600 more for each place.
    """
    second = F.unix_seconds("event_time")

    def holding(parts, count_of, place: int, start: int):
        for part in parts:
            if place < start + count_of[part]:
                return part, start
            start += count_of[part]

    def counted(rows: DataFrame, part) -> dict[int, int]:
        return {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}

    hours, out = counted(events, F.floor(second / 3600)), []
    for place in places:
        hour, start = holding(sorted(hours), hours, place, 0)
        inside = events.where(F.floor(second / 3600) == hour)
        seconds = counted(inside, second)
        at, start = holding(sorted(seconds), seconds, place, start)
        order = inside.where(second == at).select(F.unix_micros("event_time").alias("t"), "machine_id", "event_id")
        out.append(tuple(order.orderBy(*order.columns).offset(place - start).limit(1).first()))
    return out


def drifted(events: DataFrame, d: Disorder) -> DataFrame:
    """A cutover, not a scatter: of n events in the order of event time, those from index int(n * schema_drift_at) on carry
    version 2, those from int(n * schema_v3_at) on version 3."""
    if d.schema_drift_at is None:
        return events
    n = events.count()
    shares = [d.schema_drift_at] + ([d.schema_v3_at] if d.schema_v3_at is not None else [])
    first = [int(n * share) for share in shares]
    first = [k for k in (first[0], max(first)) if k < n][: len(first)]  # version 3 is within the tail of version 2
    own = F.struct(F.unix_micros("event_time"), "machine_id", "event_id")
    version = F.lit(1)
    for v, (micros, machine, event) in enumerate(at_places(events, first), 2):
        version = F.when(own >= F.struct(F.lit(micros).cast("long"), F.lit(machine), F.lit(event)), v).otherwise(version)
    return events.withColumn("schema_version", version.cast("int")).withColumn(
        "payload", versioned_payload(F.col("schema_version"), F.col("event_type"), F.col("payload"))
    )


def with_slots(events: DataFrame) -> DataFrame:
    """`slot`: place of each event among its machine's, by publish_time and event_id.

    Counted in two levels, events of an hour and then hours, so that no machine's whole history is in one task.
    """
    names = events.columns
    hourly = events.withColumn("__hour", F.floor(F.unix_seconds("publish_time") / 3600))
    counts = hourly.groupBy(F.col("machine_id").alias("__machine"), F.col("__hour").alias("__at")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("__machine").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__machine", "__at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy("machine_id", "__hour").orderBy("publish_time", "event_id")
    placed = hourly.withColumn("__place", F.row_number().over(inside) - 1)
    joined = placed.join(starts, (F.col("machine_id") == F.col("__machine")) & (F.col("__hour") == F.col("__at")))
    return joined.select(*names, (F.col("__start") + F.col("__place")).alias("slot"))


def reordered(events: DataFrame, d: Disorder, seed: int) -> DataFrame:
    """`slot`: position on the topic within a machine; a chosen event swaps places with one up to max_shift before it.

    Swaps happen inside blocks of max_shift + 1 slots, so that they are independent of each other.
    """
    slots = with_slots(events)
    if not d.out_of_order_rate or not d.out_of_order_max_shift:
        return slots.withColumn("is_reordered", F.lit(False))
    size = d.out_of_order_max_shift + 1
    block = slots.withColumn("block", F.floor(F.col("slot") / size))
    pick = draw(seed, "ooo", "event_id")
    inside = W.partitionBy("machine_id", "block")
    # of each block the chosen event of least draw moves back to the block's first slot
    chosen = F.when((pick < d.out_of_order_rate) & (F.col("slot") % size > 0), pick)
    best = F.min(chosen).over(inside)
    hit = chosen.isNotNull() & (chosen == best)
    target = F.max(F.when(hit, F.col("slot"))).over(inside)
    return (
        block.withColumn("is_reordered", hit)
        .withColumn("swap", target)
        .withColumn(
            "slot",
            F.when(hit, F.col("block") * size)
            .when(F.col("swap").isNotNull() & (F.col("slot") == F.col("block") * size), F.col("swap"))
            .otherwise(F.col("slot")),
        )
        .drop("block", "swap")
    )


def inject(events: DataFrame, d: Disorder, seed: int) -> tuple[DataFrame, DataFrame]:
    """(canonical, published).

    canonical: the events after skew and drift, with is_late, duplicate_extra and is_corrupt (every
    copy corrupted), as a manifest needs. published: one row per message with copy, slot, value fields and
    is_corrupt; a corrupt message has `corrupt_text`.
    """
    base = drifted(skewed(events, d, seed), d)
    late = draw(seed, "late", "event_id") < d.late_rate
    extra = F.when(
        draw(seed, "dup", "event_id") < d.duplicate_rate,
        1 + F.floor(draw(seed, "extra", "event_id") * d.duplicate_max_extra).cast("int"),
    ).otherwise(0)
    corrupt = draw(seed, "corrupt", "event_id") < d.corrupt_rate
    canonical = (
        base.withColumn("is_late", late).withColumn("duplicate_extra", extra).withColumn("is_corrupt", corrupt)
    )
    delay = F.pow(draw(seed, "delay", "event_id"), 2) * d.late_max_hours * 3600e6
    shifted = canonical.withColumn(
        "publish_time",
        F.timestamp_micros(F.unix_micros("publish_time") + F.when(F.col("is_late"), F.round(delay).cast("long")).otherwise(0)),
    )
    copies = reordered(shifted, d, seed).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("duplicate_extra"))))
    low, high = DUPLICATE_LAG_MS
    lag_ms = F.when(F.col("copy") > 0, low + F.floor(draw(seed, "lag", "event_id", "copy") * (high - low + 1))).otherwise(0)
    texts = F.array(*[F.lit(t) for t in TRUNCATIONS])
    which = F.floor(draw(seed, "text", "event_id") * len(TRUNCATIONS)).cast("int")
    published = copies.withColumn(
        "publish_time", F.timestamp_micros(F.unix_micros("publish_time") + (lag_ms * 1000).cast("long"))
    ).withColumn("corrupt_text", F.when(F.col("is_corrupt"), F.get(texts, which)))
    return canonical, published


def injection_summary(canonical: DataFrame, published: DataFrame, d: Disorder) -> dict[str, int]:
    """What inject() did, as InjectionLog.summary() has it for the other mode; two aggregates."""
    a = canonical.agg(
        F.count_if("is_late").alias("late"),
        F.count_if(F.col("duplicate_extra") > 0).alias("duplicated"),
        F.coalesce(F.sum("duplicate_extra"), F.lit(0)).alias("duplicate_extra"),
        F.count_if("is_corrupt").alias("corrupt"),
        F.count_distinct("machine_id").alias("machines"),
    ).first()
    moved = published.where("is_reordered and copy = 0").count()
    skewed_machines = min(d.skewed_machines, a.machines) if d.skew_max_seconds else 0
    return {
        "late": a.late,
        "duplicated": a.duplicated,
        "duplicate_extra": a.duplicate_extra,
        "out_of_order": moved,
        "corrupt": a.corrupt,
        "skewed_machines": skewed_machines,
    }


@dataclass
class InjectionLog:
    late: set[str] = field(default_factory=set)
    duplicated: dict[str, int] = field(default_factory=dict)
    out_of_order: set[str] = field(default_factory=set)
    corrupt: set[str] = field(default_factory=set)
    skewed: dict[str, float] = field(default_factory=dict)

    def summary(self) -> dict[str, int]:
        return {
            "late": len(self.late),
            "duplicated": len(self.duplicated),
            "duplicate_extra": sum(self.duplicated.values()),
            "out_of_order": len(self.out_of_order),
            "corrupt": len(self.corrupt),
            "skewed_machines": len(self.skewed),
        }


def inject_in_sequence(events: list[tuple], d: Disorder, seed: int) -> tuple[list[dict], InjectionLog, list[dict]]:
    """(published, log, canonical) of one ordered stream; a published row of a corrupt message has `text`."""
    rng, log = seeded(f"disorder:{seed}"), InjectionLog()
    names = ("event_id", "event_type", "machine_id", "event_time", "publish_time", "schema_version", "payload")
    rows = [dict(zip(names, e, strict=True)) for e in sorted(events, key=lambda e: (e[3], e[2], e[0]))]

    if d.skewed_machines and d.skew_max_seconds:
        machines = sorted({r["machine_id"] for r in rows})
        for m in rng.sample(machines, min(d.skewed_machines, len(machines))):
            log.skewed[m] = rng.uniform(-d.skew_max_seconds, d.skew_max_seconds)
        for r in rows:
            if r["machine_id"] in log.skewed:
                wander = rng.uniform(-WANDER, WANDER) * d.skew_max_seconds
                r["event_time"] += timedelta(seconds=log.skewed[r["machine_id"]] + wander)
    if d.schema_drift_at is not None:
        by_time = sorted(rows, key=lambda r: r["event_time"])
        cut2 = int(len(rows) * d.schema_drift_at)
        cut3 = int(len(rows) * d.schema_v3_at) if d.schema_v3_at is not None else len(rows)
        for i, r in enumerate(by_time):
            version = 3 if i >= max(cut2, cut3) else 2 if i >= cut2 else 1
            r["schema_version"] = version
            r["payload"] = json.dumps(to_version(json.loads(r["payload"]), r["event_type"], version), separators=(",", ":"))
    canonical = [dict(r) for r in rows]

    for r in rows:
        if rng.random() < d.late_rate:
            r["publish_time"] += timedelta(hours=d.late_max_hours * rng.random() ** 2)
            log.late.add(r["event_id"])
    rows.sort(key=lambda r: (r["publish_time"], r["machine_id"], r["event_id"]))
    if d.out_of_order_rate:
        places: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            places.setdefault(r["machine_id"], []).append(i)
        for at in places.values():
            for slot in range(len(at)):
                hit = rng.random() < d.out_of_order_rate
                if hit and slot:
                    other = slot - rng.randint(1, min(d.out_of_order_max_shift, slot))
                    rows[at[slot]], rows[at[other]] = rows[at[other]], rows[at[slot]]
                    log.out_of_order.add(rows[at[other]]["event_id"])
    published = []
    for r in rows:
        published.append(r)
        if rng.random() < d.duplicate_rate:
            extra = rng.randint(1, d.duplicate_max_extra)
            log.duplicated[r["event_id"]] = extra
            for _ in range(extra):
                lag = timedelta(milliseconds=rng.randint(*DUPLICATE_LAG_MS))
                published.append(r | {"publish_time": r["publish_time"] + lag})
    if d.corrupt_rate:
        for i, r in enumerate(published):
            if rng.random() < d.corrupt_rate:
                published[i] = r | {"text": rng.choice(TRUNCATIONS)}
                log.corrupt.add(r["event_id"])
    return published, log, canonical
