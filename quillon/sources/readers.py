"""Strict readers: entities and golden sets as JSON lines, Markdown seeds, intents.

Readers never infer a schema. Rows that break their contract are kept apart with
a reason, so that nothing is lost silently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import entity_id_valid

LINE_BYTES = 256 * 1024


@dataclass(frozen=True)
class Field:
    """A declared field: numeric, text, boolean, reflist or timestamp."""

    name: str
    kind: str
    filterable: bool = True


JSON_TYPES = {"numeric": "double", "text": "string", "boolean": "boolean", "reflist": "array<string>", "timestamp": "bigint"}


def read_entities(spark: SparkSession, path: str, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a JSON-lines file; each declared field is required and strictly typed.

    accepted: entity_id, source_revision (1 if absent) and the fields.
    rejected: line and reason.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    raw = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    revision = F.try_variant_get(F.try_parse_json("value"), F.lit("$.source_revision"), "bigint")
    json = F.try_parse_json("value")
    parsed = lines.withColumn("_json", json).withColumn("_raw", raw)
    wrong: Column = F.lit(None).cast("string")
    columns = []
    for f in fields:
        value = F.try_variant_get(F.col("_json"), F.lit(f"$.{f.name}"), JSON_TYPES[f.kind])
        kind = F.schema_of_variant(F.try_variant_get(F.col("_json"), F.lit(f"$.{f.name}"), "variant"))
        fits = {
            "numeric": kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"),
            "text": kind == "STRING",
            "boolean": kind == "BOOLEAN",
            "reflist": kind.isin("ARRAY<STRING>", "ARRAY<VOID>"),
            "timestamp": kind == "BIGINT",
        }[f.kind]
        wrong = F.coalesce(wrong, F.when(F.col("_raw").isNull() | ~F.map_contains_key("_raw", F.lit(f.name)), f"missing:{f.name}").when(~F.coalesce(fits, F.lit(False)), f"type:{f.name}"))
        columns.append(value.alias(f.name))
    entity = F.try_variant_get(F.col("_json"), F.lit("$.entity_id"), "string")
    reason = (
        F.when(F.octet_length("value") > LINE_BYTES, "line_too_long")
        .when(F.col("_json").isNull(), "json")
        .when(entity.isNull() | ~entity_id_valid(entity), "entity_id")
        .otherwise(wrong)
    )
    judged = parsed.withColumn("_reason", reason)
    accepted = judged.where("_reason is null").select(entity.alias("entity_id"), F.coalesce(revision, F.lit(1)).alias("source_revision"), *columns)
    return accepted, judged.where("_reason is not null").select(F.col("value").alias("line"), F.col("_reason").alias("reason"))


def entity_facts(entities: DataFrame, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """(facts, refs): wide entities as long typed facts and exploded references."""
    none = F.lit(None)
    rows, lists = [], []
    for f in fields:
        c = F.col(f.name)
        if f.kind == "reflist":
            lists.append(F.struct(F.lit(f.name).alias("field_name"), F.array_distinct(c).alias("refs")))
        else:
            number = c.cast("double") if f.kind in ("numeric", "timestamp") else c.cast("int").cast("double") if f.kind == "boolean" else none.cast("double")
            rows.append(F.struct(F.lit(f.name).alias("field_name"), number.alias("value_numeric"), (c if f.kind == "text" else none.cast("string")).alias("value_text")))
    facts = entities.select("entity_id", "source_revision", F.explode(F.array(*rows)).alias("f")).select("entity_id", "source_revision", "f.*")
    empty = F.array().cast("array<struct<field_name:string,refs:array<string>>>")
    refs = entities.select("entity_id", F.explode(F.array(*lists) if lists else empty).alias("f")).select("entity_id", "f.field_name", F.explode("f.refs").alias("ref_value"))
    return facts, refs


GOLDEN = "id string, query string, kind string, expected_entity_ids array<string>, must_exclude_entity_ids array<string>, filters string, notes string"
KINDS = ("synonym", "intent", "negation", "attribute_filter", "negative")


def read_golden(spark: SparkSession, path: str, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(goldens, problems): problems are rows (id, problem) of bad kinds, duplicates and unknown entities."""
    rows = spark.read.schema(GOLDEN).json(path)
    kinds = rows.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select("id", F.lit("kind").alias("problem"))
    twice = rows.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem"))
    problems = kinds.unionByName(twice)
    if entities is not None:
        named = rows.select("id", F.explode(F.concat(F.coalesce("expected_entity_ids", F.array().cast("array<string>")), F.coalesce("must_exclude_entity_ids", F.array().cast("array<string>")))).alias("entity_id"))
        problems = problems.unionByName(named.join(entities.select("entity_id"), "entity_id", "left_anti").select("id", F.lit("unknown_entity").alias("problem")).distinct())
    return rows, problems


def read_seed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with front matter: page_id, entity_id, title, aliases, tags and body."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n", "\n").alias("t"))
    head = F.regexp_extract("t", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 1)
    scalar = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)), F.lit(""))
    items = lambda name: F.filter(F.transform(F.split(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\[(.*?)\]", 1), ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", ""))), lambda x: x != "")
    body = F.regexp_extract("t", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 2)
    return text.select(scalar("page_id").alias("page_id"), scalar("entity_id").alias("entity_id"), scalar("title").alias("title"), scalar("entity_type").alias("entity_type"), items("aliases").alias("aliases"), items("tags").alias("tags"), body.alias("content"))


def split_sections(pages: DataFrame, default: str = "Introduction") -> DataFrame:
    """page_id, position, heading, body: cut before each line that begins with "## "; what stands before the first one gets the default heading."""
    cut = "\ue000"
    parts = F.split(F.regexp_replace("content", r"(?m)^## ", f"{cut}## "), cut)
    rows = pages.select("page_id", F.posexplode(parts).alias("position", "part")).where((F.col("position") > 0) | F.col("part").rlike(r"\S"))
    headed = F.col("part").startswith("## ")
    strip = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return rows.select("page_id", "position", F.when(headed, strip(F.regexp_extract("part", r"\A## ([^\n]*)", 1))).otherwise(default).alias("heading"), strip(F.when(headed, F.regexp_replace("part", r"\A## [^\n]*\n?", "")).otherwise(F.col("part"))).alias("body"))
