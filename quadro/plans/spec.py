"""What a tabulation, a filter or a conversion is: plain data, checked before use."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

UNCLASSIFIED = "__unclassified__"
UNCLASSIFIED_LABEL = "Não classificados"


class PlanError(ValueError):
    """A plan that can't run, with every reason found."""


@dataclass(frozen=True)
class Category:
    sequence: int
    label: str
    parent: int | None = None  # sequence of the subtotal it adds into
    totalled: bool = True  # whether totals count it


@dataclass(frozen=True)
class CodeRange:
    """Codes from `low` to `high` (the same for one code) mean category `sequence`."""

    sequence: int
    low: str
    high: str


@dataclass(frozen=True)
class Conversion:
    """A code table. precedence: which of several matching rules wins. bands: rules are
    upper limits of numbers, in order, instead of codes."""

    name: str
    categories: tuple[Category, ...]
    rules: tuple[CodeRange, ...] = ()
    bands: tuple[tuple[int, float], ...] = ()
    precedence: str = "last"
    code_length: int = 1


@dataclass(frozen=True)
class Dimension:
    field: str
    conversion: Conversion | None = None
    start: int = 1
    length: int | None = None
    lookup: str | None = None  # name of a table of key and label
    unclassified: str = "omit"  # or "discriminate"


@dataclass(frozen=True)
class Filter:
    field: str
    mode: str = "include"
    categories: tuple[str, ...] | None = None
    conversion: Conversion | None = None
    start: int = 1
    include_unclassified: bool = False
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class Rule:
    """Conditions over several fields; `exclude` also removes what meets all of them."""

    name: str
    conditions: tuple[Filter, ...]
    action: str = "flag"


@dataclass(frozen=True)
class Measure:
    kind: str = "count"  # count, weighted, sum
    field: str | None = None
    label: str | None = None

    def heading(self, compatible: bool = False) -> str:
        return self.label or ("Valor" if self.kind == "sum" else "Freqüência" if compatible else "Frequência")


@dataclass(frozen=True)
class TabulationSpec:
    rows: Dimension
    columns: Dimension | None = None
    measures: tuple[Measure, ...] = (Measure(),)
    filters: tuple[Filter, ...] = ()
    rules: tuple[Rule, ...] = ()
    suppress_rows: bool = False
    suppress_columns: bool = False

    def fields_used(self) -> list[str]:
        """Every field that the plan reads, once each."""
        filters = [*self.filters, *(c for r in self.rules for c in r.conditions)]
        names = [self.rows.field, *([self.columns.field] if self.columns else []), *(m.field for m in self.measures if m.field), *(f.field for f in filters)]
        return list(dict.fromkeys(names))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)


@dataclass(frozen=True)
class QueryPlan:
    spec: TabulationSpec
    warnings: list[str] = field(default_factory=list)


def _filter_faults(f: Filter, columns: list[str]) -> list[str]:
    faults = [] if f.field in columns else [f"filter: no field {f.field}"]
    ranged = f.low is not None or f.high is not None
    if f.mode not in ("include", "exclude"):
        faults.append(f"filter on {f.field}: mode {f.mode}")
    if ranged == (f.categories is not None):
        faults.append(f"filter on {f.field}: give either categories or a range")
    if f.categories is not None and not f.categories and not f.include_unclassified:
        faults.append(f"filter on {f.field}: no category")
    if f.low is not None and f.high is not None and (f.low > f.high or f.low == f.high and (f.low_open or f.high_open)):
        faults.append(f"filter on {f.field}: empty range")
    return faults


def conversion_faults(c: Conversion) -> list[str]:
    """Repeated or unknown sequences, subtotals in a circle, unordered bands."""
    known = [x.sequence for x in c.categories]
    faults = [f"{c.name}: category {s} twice" for s in {s for s in known if known.count(s) > 1}]
    faults += [f"{c.name}: rule for unknown category {r.sequence}" for r in c.rules if r.sequence not in known]
    faults += [f"{c.name}: unknown subtotal {x.parent}" for x in c.categories if x.parent is not None and x.parent not in known]
    uppers = [u for _, u in c.bands]
    if uppers != sorted(uppers):
        faults.append(f"{c.name}: bands aren't in order")
    parent = {x.sequence: x.parent for x in c.categories}
    for s in known:
        seen = {s}
        while (s := parent.get(s)) is not None:
            if s in seen:
                faults.append(f"{c.name}: subtotals in a circle at {s}")
                break
            seen.add(s)
    return faults


def compile_plan(spec: TabulationSpec, columns: list[str]) -> QueryPlan:
    """Checks a spec against a source's columns; raises PlanError with all faults."""
    faults, warnings = [], []
    for d in [spec.rows, *([spec.columns] if spec.columns else [])]:
        if d.field not in columns:
            faults.append(f"dimension: no field {d.field}")
        if d.conversion and d.lookup:
            faults.append(f"dimension {d.field}: conversion and lookup")
        if d.start < 1:
            faults.append(f"dimension {d.field}: start {d.start}")
        if d.conversion:
            faults += conversion_faults(d.conversion)
            if d.conversion.bands and d.start != 1:
                warnings.append(f"{d.field}: numeric bands ignore the start position")
        if d.unclassified not in ("omit", "discriminate"):
            faults.append(f"dimension {d.field}: unclassified {d.unclassified}")
    if not spec.measures:
        faults.append("no measure")
    if len(spec.measures) > 1 and spec.columns:
        faults.append("several measures don't go with a column dimension")
    for m in spec.measures:
        if m.kind not in ("count", "weighted", "sum") or (m.kind == "count") == (m.field is not None):
            faults.append(f"measure {m.kind} with field {m.field}")
        elif m.field and m.field not in columns:
            faults.append(f"measure: no field {m.field}")
    for f in spec.filters:
        faults += _filter_faults(f, columns)
    for r in spec.rules:
        if len(r.conditions) < 2 or len({c.field for c in r.conditions}) < 2:
            faults.append(f"rule {r.name}: needs two conditions over two fields")
        if r.action not in ("flag", "exclude"):
            faults.append(f"rule {r.name}: action {r.action}")
        for c in r.conditions:
            faults += _filter_faults(c, columns)
    if faults:
        raise PlanError("; ".join(dict.fromkeys(faults)))
    return QueryPlan(spec, warnings)
