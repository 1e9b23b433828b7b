"""Rule planner: which text repairs a page gets, as expressions over its profile.

A fix has an id, an order, a condition on (profile, backend) and an expression from text to text. The
plan of a page is an array of ids; overrides (JSON) remove fixes or replace the plan where they match.
A matching rule's list replaces the plan as a whole and may name a disabled fix.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import dehyphenated, spaced

#: Names of the extraction backends.
LAYOUT_BACKEND, TEXT_BACKEND = "Docling 🧠", "PyMuPDF4LLM ⚡"
RULE_FIELDS, RULE_OPS = ("columns", "backend", "has_tables", "has_index"), ("eq", "gte", "lte")


@dataclass(frozen=True)
class Fix:
    id: str
    order: int
    when: Callable[[Column, Column], Column]
    apply: Callable[[Column, dict[str, Column]], Column]
    description: str = ""


def _never(profile: Column, backend: Column) -> Column:
    return F.lit(False)


def _always(profile: Column, backend: Column) -> Column:
    return F.lit(True)


#: The built-in fixes. `parts` holds per-page results of heavier operators: split, reordered, titled.
FIXES = (
    Fix("dehyphenate", 10, lambda p, b: b == LAYOUT_BACKEND, lambda t, parts: dehyphenated(t), "join words broken over lines"),
    Fix("split_glued", 20, lambda p, b: (b == LAYOUT_BACKEND) & (p["columns"] >= 2), lambda t, parts: parts.get("split", t), "split paragraphs glued over columns"),
    Fix("reorder_columns", 30, lambda p, b: (b != LAYOUT_BACKEND) & (p["columns"] >= 2) & p["columns_overlap"], lambda t, parts: parts.get("reordered", t), "rebuild the reading order"),
    Fix("reorder_columns_title", 35, _never, lambda t, parts: parts.get("titled", t), "reading order with titles first"),
    Fix("spacing", 90, _always, lambda t, parts: spaced(t), "blanks after glued markup"),
)


@dataclass
class Overrides:
    disable: list[str] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str | None) -> Overrides:
        """Tolerant: what is not of the right shape is left out."""
        try:
            raw = json.loads(text or "{}")
        except ValueError:
            return cls()
        if not isinstance(raw, dict):
            return cls()
        names = lambda x: [i for i in x if isinstance(i, str)] if isinstance(x, list) else []
        rules = [{"when": r["when"] if isinstance(r.get("when"), dict) else {}, "apply": names(r.get("apply"))} for r in raw.get("rules") or [] if isinstance(r, dict)] if isinstance(raw.get("rules"), list) else []
        return cls(names(raw.get("disable")), rules)


def matches(rule: dict, profile: Column, backend: Column) -> Column:
    """Every condition holds; an unknown field or operator never does; no condition always does."""
    out = F.lit(True)
    for name, wanted in rule["when"].items():
        if name not in RULE_FIELDS:
            return F.lit(False)
        value = backend if name == "backend" else profile[name]
        tests = wanted if isinstance(wanted, dict) else {"eq": wanted}
        for op, than in tests.items():
            if op not in RULE_OPS or not isinstance(than, (str, int, float, bool)):
                return F.lit(False)
            out = out & {"eq": value == than, "gte": value >= than, "lte": value <= than}[op]
    return F.coalesce(out, F.lit(False))


def plan(profile: Column, backend: Column | str, mode: str = "auto", overrides: Overrides | None = None, fixes: tuple[Fix, ...] = FIXES) -> Column:
    """The ids to apply, in order, as an array column."""
    over, back, by = overrides or Overrides(), F.lit(backend) if isinstance(backend, str) else backend, {f.id: f for f in fixes}
    none = F.array().cast("array<string>")
    if mode != "auto":
        return F.array(F.lit(mode)) if mode in by and mode not in over.disable else none
    base = F.array_compact(F.array(*(F.when(f.when(profile, back), F.lit(f.id)) for f in sorted(fixes, key=lambda f: f.order) if f.id not in over.disable)))
    if not over.rules:
        return base
    chosen = F.array_distinct(F.flatten(F.array(*(F.when(matches(r, profile, back), F.array(*map(F.lit, r["apply"])).cast("array<string>")).otherwise(none) for r in over.rules))))
    known = sorted((f for f in fixes), key=lambda f: f.order)
    sorted_chosen = F.array_compact(F.array(*(F.when(F.array_contains(chosen, f.id), F.lit(f.id)) for f in known)))
    return F.when(F.size(sorted_chosen) > 0, sorted_chosen).otherwise(base)
