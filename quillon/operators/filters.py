"""Structured filters over typed facts, compiled to semi and anti joins."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY_CAP = 10_000


@dataclass(frozen=True)
class NumericRange:
    field: str
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class TextEquals:
    field: str
    value: str


@dataclass(frozen=True)
class RefContains:
    """Any of the references."""

    field: str
    refs: tuple[str, ...]


@dataclass(frozen=True)
class RefExcludes:
    """None of the references; an entity without any passes."""

    field: str
    refs: tuple[str, ...]


Condition = NumericRange | TextEquals | RefContains | RefExcludes


def passing(entities: DataFrame, facts: DataFrame, refs: DataFrame, conditions: list[Condition]) -> DataFrame:
    """The rows of `entities` (entity_id) that meet all conditions. An open range and an empty exclusion ask for nothing."""
    out = entities
    for c in conditions:
        if isinstance(c, NumericRange):
            if c.min is None and c.max is None:
                continue
            test = F.col("field_name") == c.field
            if c.min is not None:
                test &= F.col("value_numeric") >= c.min
            if c.max is not None:
                test &= F.col("value_numeric") <= c.max
            out = out.join(facts.where(test).select("entity_id"), "entity_id", "left_semi")
        elif isinstance(c, TextEquals):
            out = out.join(facts.where((F.col("field_name") == c.field) & (F.col("value_text") == c.value)).select("entity_id"), "entity_id", "left_semi")
        elif isinstance(c, RefContains):
            out = out.join(refs.where((F.col("field_name") == c.field) & F.col("ref_value").isin(*c.refs)).select("entity_id"), "entity_id", "left_semi") if c.refs else out.where(F.lit(False))
        elif c.refs:
            out = out.join(refs.where((F.col("field_name") == c.field) & F.col("ref_value").isin(*c.refs)).select("entity_id"), "entity_id", "left_anti")
    return out


def entity_filter(facts: DataFrame, refs: DataFrame, conditions: list[Condition], cap: int | None = ENTITY_CAP) -> DataFrame:
    """Distinct entities that pass, the first `cap` by id (the cap is part of the operator)."""
    found = passing(facts.select("entity_id").distinct(), facts, refs, conditions)
    return found.orderBy("entity_id").limit(cap) if cap else found


def anchor_scope(facts: DataFrame, refs: DataFrame, conditions: list[Condition], anchor: str = "category") -> DataFrame:
    """Distinct anchors (page entities) of which any one entity passes."""
    anchors = facts.where(F.col("field_name") == anchor).select("entity_id", F.col("value_text").alias("anchor"))
    return passing(anchors, facts, refs, conditions).select("anchor").distinct()


def relax(conditions: list[Condition]) -> list[Condition] | None:
    """Once, the first numeric range: without its maximum if it has one, else it goes. None if there is nothing to relax."""
    for k, c in enumerate(conditions):
        if isinstance(c, NumericRange):
            return conditions[:k] + ([replace(c, max=None)] if c.max is not None else []) + conditions[k + 1 :]
    return None


def merge(conditions: list[Condition]) -> list[Condition]:
    """Conditions without conflicts: equal ones once, ranges of a field intersected (both stay if that is empty), references intersected less the excluded, exclusions united."""
    out: list[Condition] = []
    for c in conditions:
        if c in out:
            continue
        same = next((k for k, x in enumerate(out) if type(x) is type(c) and x.field == c.field), None)
        if isinstance(c, NumericRange) and same is not None:
            low = max((x for x in (c.min, out[same].min) if x is not None), default=None)
            high = min((x for x in (c.max, out[same].max) if x is not None), default=None)
            if low is not None and high is not None and low > high:
                out.append(c)
            else:
                out[same] = NumericRange(c.field, low, high)
        elif isinstance(c, RefContains) and same is not None:
            out[same] = RefContains(c.field, tuple(r for r in out[same].refs if r in c.refs))
        elif isinstance(c, RefExcludes) and same is not None:
            out[same] = RefExcludes(c.field, tuple(dict.fromkeys(out[same].refs + c.refs)))
        else:
            out.append(c)
    excluded = {c.field: set(c.refs) for c in out if isinstance(c, RefExcludes)}
    return [RefContains(c.field, tuple(r for r in c.refs if r not in excluded.get(c.field, ()))) if isinstance(c, RefContains) else c for c in out]


def parse(text: str) -> list[Condition]:
    """The command line's grammar: comma-separated `field<=x`, `field>=x`, `field not_in=a|b`, `field in=a|b`, `field=value`."""
    out: list[Condition] = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        for sign, make in (
            ("<=", lambda f, v: NumericRange(f, max=float(v))),
            (">=", lambda f, v: NumericRange(f, min=float(v))),
            ("not_in=", lambda f, v: RefExcludes(f, tuple(v.split("|")))),
            ("in=", lambda f, v: RefContains(f, tuple(v.split("|")))),
            ("=", lambda f, v: TextEquals(f, v)),
        ):
            field, found, value = part.partition(sign)
            if found:
                field, value = field.strip(), value.strip()
                if not re.fullmatch(r"\w+", field) or not value or sign == "=" and value in ("true", "false"):
                    raise ValueError(f"bad filter: {part}")
                out.append(make(field, value))
                break
        else:
            raise ValueError(f"bad filter: {part}")
    return out
