"""Plant and scenario configuration: defaults, YAML loading, range checks and referential integrity."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import date
from functools import lru_cache


@dataclass(frozen=True)
class Machine:
    id: str
    line: str
    nominal_cycle_s: float


@dataclass(frozen=True)
class Product:
    sku: str
    line: str
    defect_base_rate: float


@dataclass(frozen=True)
class Shift:
    id: str
    start: str
    end: str
    breaks: tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Plant:
    machines: tuple[Machine, ...]
    products: tuple[Product, ...]
    lines: dict[str, tuple[str, ...]]
    shifts: tuple[Shift, ...]
    units: tuple[int, int]
    changeover_minutes: tuple[float, float]
    defect_codes: tuple[str, ...]
    badges: tuple[str, ...]

    def products_of(self, line: str) -> list[Product]:
        return [p for p in self.products if p.line == line]

    def problems(self) -> list[str]:
        """Referential integrity: an empty list if the plant is sound."""
        ids = {m.id for m in self.machines}
        listed = {m for ms in self.lines.values() for m in ms}
        out = [f"line {line} lists unknown machine {m}" for line, ms in self.lines.items() for m in ms if m not in ids]
        out += [f"machine {m.id} is on unknown line {m.line}" for m in self.machines if m.line not in self.lines]
        out += [f"machine {m.id} is on no line's list" for m in self.machines if m.id not in listed]
        out += [f"product {p.sku} is for unknown line {p.line}" for p in self.products if p.line not in self.lines]
        out += [f"line {line} has no machines" for line, ms in self.lines.items() if not ms]
        if self.units[0] > self.units[1]:
            out.append("least units exceed most units")
        if not self.badges:
            out.append("no operator badges")
        return out


#: Fixed values of the default plant.
DEFAULT = Plant(
    machines=(
        Machine("MW1-A-01", "A", 92),
        Machine("MW1-A-02", "A", 92),
        Machine("MW1-A-03", "A", 118),
        Machine("MW1-A-04", "A", 64),
        Machine("MW1-B-01", "B", 145),
        Machine("MW1-B-02", "B", 145),
        Machine("MW1-B-03", "B", 71),
        Machine("MW1-B-04", "B", 88),
    ),
    products=(
        Product("HSG-114", "A", 0.021),
        Product("HSG-160", "A", 0.028),
        Product("MAN-4W", "B", 0.017),
        Product("MAN-6W", "B", 0.034),
    ),
    lines={
        "A": ("MW1-A-01", "MW1-A-02", "MW1-A-03", "MW1-A-04"),
        "B": ("MW1-B-01", "MW1-B-02", "MW1-B-03", "MW1-B-04"),
    },
    shifts=(
        Shift("A", "06:00", "14:30", (("09:00", 15), ("11:30", 30))),
        Shift("B", "14:30", "23:00", (("17:00", 15), ("19:30", 30))),
    ),
    units=(40, 400),
    changeover_minutes=(12, 45),
    defect_codes=("DIM-OOT", "SURF-FIN", "BURR", "MAT-INCL", "SETUP", "HANDLING"),
    badges=("OP-1042", "OP-1108", "OP-1177", "OP-1203", "OP-1250", "OP-1319"),
)


@dataclass(frozen=True)
class Disorder:
    late_rate: float = 0.02
    late_max_hours: float = 6.0
    duplicate_rate: float = 0.01
    duplicate_max_extra: int = 3
    out_of_order_rate: float = 0.03
    out_of_order_max_shift: int = 12
    skewed_machines: int = 2
    skew_max_seconds: float = 90.0
    schema_drift_at: float | None = 0.5
    schema_v3_at: float | None = None
    corrupt_rate: float = 0.001

    def __post_init__(self):
        for name in ("late_rate", "duplicate_rate", "out_of_order_rate", "corrupt_rate"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is a share")
        for name in ("late_max_hours", "skew_max_seconds", "skewed_machines", "out_of_order_max_shift"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")
        if self.duplicate_max_extra < 1:
            raise ValueError("duplicate_max_extra is at least 1")
        for name in ("schema_drift_at", "schema_v3_at"):
            if getattr(self, name) is not None and not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is a share")

    @classmethod
    def off(cls) -> Disorder:
        return cls(0, 0, 0, 1, 0, 0, 0, 0, None, None, 0)


@dataclass(frozen=True)
class Scenario:
    seed: int = 42
    start_date: date = date(2026, 3, 2)
    days: int = 1
    disorder: Disorder = field(default_factory=Disorder)

    def __post_init__(self):
        if self.days < 1:
            raise ValueError("days is at least 1")


def _known(cls, values: dict) -> dict:
    extra = set(values) - {f.name for f in fields(cls)}
    if extra:
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    return values


def _yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def load_scenario(path: str) -> Scenario:
    raw = _yaml(path)
    run = _known(Scenario, dict(raw.get("run", {})))
    if isinstance(run.get("start_date"), str):
        run["start_date"] = date.fromisoformat(run["start_date"])
    return Scenario(**run, disorder=Disorder(**_known(Disorder, dict(raw.get("disorder", {})))))


def load_plant(path: str) -> Plant:
    raw = _yaml(path)
    plant = Plant(
        tuple(Machine(m["id"], m["line"], m["nominal_cycle_s"]) for m in raw["machines"]),
        tuple(Product(p["sku"], p["line"], p["defect_base_rate"]) for p in raw["products"]),
        {line["id"]: tuple(line["machines"]) for line in raw["lines"]},
        tuple(
            Shift(s["id"], s["start"], s["end"], tuple((b["start"], b["minutes"]) for b in s.get("breaks", [])))
            for s in raw["shifts"]
        ),
        (raw["work_orders"]["units_min"], raw["work_orders"]["units_max"]),
        (raw["work_orders"]["changeover_minutes"]["min"], raw["work_orders"]["changeover_minutes"]["max"]),
        tuple(c["code"] for c in raw["defect_codes"]),
        tuple(raw["operators"]["badge_ids"]),
    )
    if problems := plant.problems():
        raise ValueError("; ".join(problems))
    return plant


@lru_cache
def get_plant(path: str | None = None) -> Plant:
    return load_plant(path) if path else DEFAULT
