"""Domain packs and intents: small YAML files, read on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize
from ..operators.filters import Condition, NumericRange, RefExcludes, TextEquals
from .readers import Field

# Limits of an intents file, and the least number of golden queries of each kind.
INTENT_BYTES, INTENTS, INTENT_PHRASES = 1 << 20, 1000, 64
GOLDEN_QUOTAS = {"synonym": 25, "intent": 20, "negation": 20, "attribute_filter": 20, "negative": 15}


@dataclass
class Pack:
    name: str
    version: str
    fields: list[Field]
    filters: list[str]
    settings: dict = field(default_factory=dict)


@dataclass
class Intent:
    """Phrases with one rule: expansion, attribute or negation."""

    id: str
    phrases: list[str]
    kind: str
    text: str | None = None
    conditions: list[Condition] = field(default_factory=list)


def read_pack(path: str) -> Pack:
    raw = yaml.safe_load(Path(path).read_text())
    fields = [Field(f["name"], f["field_type"], f.get("filterable", True)) for e in raw.get("entities", []) for f in e.get("fields", [])]
    allowed = raw.get("query", {}).get("filters", [])
    unknown = [f for f in allowed if f not in {x.name for x in fields if x.filterable}]
    if unknown:
        raise ValueError(f"filters that are no filterable fields: {unknown}")
    return Pack(raw["name"], str(raw["version"]), fields, allowed, {k: raw.get(k, {}) for k in ("compile", "qug")})


def find_packs(folder: str) -> list[Pack]:
    """The packs of a folder tree, by name."""
    return sorted((read_pack(str(p)) for p in Path(folder).rglob("domain.yaml")), key=lambda p: p.name)


def parse_intents(text: str, kinds: dict[str, str] | None = None) -> list[Intent]:
    """kinds: the declared kind of each field; an `equals` on a numeric one is a range of one value."""
    if len(text.encode()) > INTENT_BYTES:
        raise ValueError("intents file too large")
    rows = (yaml.safe_load(text) or {}).get("intents") or []
    if len(rows) > INTENTS:
        raise ValueError("too many intents")
    out: list[Intent] = []
    for r in rows:
        rules = [k for k in ("expansion", "attribute", "negation") if k in r]
        if len(rules) != 1 or not r.get("phrases") or len(r["phrases"]) > INTENT_PHRASES or any(x.id == r["id"] for x in out):
            raise ValueError(f"bad intent: {r.get('id')}")
        rule = r[rules[0]]
        if rules[0] == "expansion":
            out.append(Intent(r["id"], r["phrases"], "intent_template", rule.get("text")))
        elif rules[0] == "negation":
            out.append(Intent(r["id"], r["phrases"], "negation", None, [RefExcludes(rule["field"], tuple(rule["refs"]))]))
        elif "equals" in rule:
            numeric = (kinds or {}).get(rule["field"]) == "numeric"
            one = NumericRange(rule["field"], float(rule["equals"]), float(rule["equals"])) if numeric else TextEquals(rule["field"], str(rule["equals"]))
            out.append(Intent(r["id"], r["phrases"], "attribute", None, [one]))
        else:
            out.append(Intent(r["id"], r["phrases"], "attribute", None, [NumericRange(rule["field"], rule.get("min"), rule.get("max"))]))
    return out


def intent_edges(spark: SparkSession, intents: list[Intent]) -> DataFrame:
    """src, dst, kind, intent_id: a template leads to its text, the other rules are loops at their phrase."""
    rows = [(p, i.text if i.kind == "intent_template" and i.text else p, i.kind, i.id) for i in intents for p in i.phrases]
    df = spark.createDataFrame(rows, "src string, dst string, kind string, intent_id string")
    return df.select(normalize(F.col("src")).alias("src"), normalize(F.col("dst")).alias("dst"), "kind", "intent_id").where("src is not null and dst is not null").distinct()


def quota_gaps(goldens: DataFrame) -> DataFrame:
    """kind, quota, n of the kinds with fewer golden queries than their quota."""
    quota = F.create_map(*[F.lit(x) for kv in GOLDEN_QUOTAS.items() for x in kv])
    kinds = goldens.sparkSession.createDataFrame([(k,) for k in GOLDEN_QUOTAS], "kind string")
    counts = goldens.groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.join(counts, "kind", "left").select("kind", quota[F.col("kind")].alias("quota"), F.coalesce("n", F.lit(0)).alias("n")).where("n < quota")
