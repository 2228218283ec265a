"""The knowledge-base model over the driver's tables, and its SQL twin for the oracle.

Each view is stated twice: as a DataFrame and as a CTE of the same name, so that
every query's SQL begins with `ctes(...)` of what it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Model:
    """Views by name, lazily built, on one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def pages(self) -> DataFrame:
        """Knowledge pages: documents with a status from their label."""
        docs, labels = self.table("documents"), self.table("labels")
        status = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "quarantined").otherwise("candidate")
        title = F.substring("text", 1, 40)
        return docs.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("page_id"),
            F.col("lang").alias("domain"),
            F.concat_ws(":", "lang", F.lit("doc"), F.col("doc_id").cast("string")).alias("entity_id"),
            title.alias("title"),
            F.col("text").alias("content"),
            "source",
            status.alias("status"),
            (F.col("doc_id") % 7 + 1).alias("generation"),
            F.coalesce("toxic", F.lit(0)).alias("toxic"),
        )

    def facts(self) -> DataFrame:
        """Typed facts, one row per entity and field."""
        part = self.table("part")
        field = lambda name, number, text: F.struct(F.lit(name).alias("field_name"), number.cast("double").alias("value_numeric"), text.cast("string").alias("value_text"))
        none = F.lit(None)
        rows = F.array(
            field("p_size", F.col("p_size"), none),
            field("p_retailprice", F.col("p_retailprice"), none),
            field("p_brand", none, F.col("p_brand")),
            field("p_type", none, F.col("p_type")),
            field("category", none, F.concat(F.lit("shop:brand:"), F.col("p_brand"))),
        )
        return part.select(F.concat(F.lit("shop:part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.explode(rows).alias("f")).select("entity_id", "f.*")

    def refs(self) -> DataFrame:
        """Multi-valued references, a set per entity and field."""
        items = self.table("lineitem").select("l_partkey", "l_suppkey").distinct()
        return items.select(F.concat(F.lit("shop:part:"), F.col("l_partkey").cast("string")).alias("entity_id"), F.lit("supplier_ids").alias("field_name"), F.concat(F.lit("shop:supplier:"), F.col("l_suppkey").cast("string")).alias("ref_value"))

    def logs(self) -> DataFrame:
        """Query log: views and errors."""
        events = self.table("events").where("event_type in ('view', 'error')")
        return events.select(
            F.col("event_id").alias("log_id"),
            F.concat(F.lit("  Query  "), F.get_json_object("props", "$.k"), F.lit(" Text ")).alias("query_text"),
            (F.col("user_id") % 3).alias("hit_count"),
            F.col("value").alias("latency_ms"),
            "ts",
            F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("user_id") % 3 + 1).cast("int")).alias("domain"),
            (F.col("event_type") == "error").alias("rewrite_failure"),
            (F.col("event_id") % 4 == 0).alias("candidate_empty_initial"),
            (F.col("event_id") % 8 == 0).alias("relaxation_succeeded"),
        )

    def feedback(self) -> DataFrame:
        """Feedback events: clicks, adoptions, ratings."""
        events = self.table("events").where("event_type in ('click', 'purchase', 'signup')")
        kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "purchase", "adopt").otherwise("rate")
        return events.select(
            "event_id",
            F.concat(F.lit("key-"), (F.col("event_id") % 5000).cast("string")).alias("idempotency_key"),
            F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("user_id") % 3 + 1).cast("int")).alias("domain"),
            (F.col("event_id") - F.col("event_id") % 2).alias("log_id"),
            kind.alias("kind"),
            F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("page_id"),
            F.when(kind == "rate", (F.col("event_id") % 7).cast("int")).alias("rating"),
            F.col("props").alias("metadata_json"),
            F.col("ts").alias("received_at"),
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.concat(F.lit("v:label:"), F.col("label").cast("string")).alias("entity_id"), "label")


CTES = {
    "pages": """pages as (select d.doc_id page_id, lang domain, lang || ':doc:' || cast(d.doc_id as varchar) entity_id, substring(text, 1, 40) title, text content, source,
      case when quality = 1 then 'accepted' when quality = 0 then 'quarantined' else 'candidate' end status, d.doc_id % 7 + 1 generation, coalesce(toxic, 0) toxic
      from documents d left join labels l on d.doc_id = l.doc_id)""",
    "facts": """facts as (select 'shop:part:' || cast(p_partkey as varchar) entity_id, f.* from part, lateral (values
      ('p_size', cast(p_size as double), cast(null as varchar)), ('p_retailprice', p_retailprice, null), ('p_brand', null, p_brand), ('p_type', null, p_type), ('category', null, 'shop:brand:' || p_brand)) f(field_name, value_numeric, value_text))""",
    "refs": """refs as (select distinct 'shop:part:' || cast(l_partkey as varchar) entity_id, 'supplier_ids' field_name, 'shop:supplier:' || cast(l_suppkey as varchar) ref_value from lineitem)""",
    "logs": """logs as (select event_id log_id, '  Query  ' || json_extract_string(props, '$.k') || ' Text ' query_text, user_id % 3 hit_count, value latency_ms, ts,
      (['en', 'de', 'fr'])[user_id % 3 + 1] domain, event_type = 'error' rewrite_failure, event_id % 4 = 0 candidate_empty_initial, event_id % 8 = 0 relaxation_succeeded
      from events where event_type in ('view', 'error'))""",
    "feedback": """feedback as (select event_id, 'key-' || cast(event_id % 5000 as varchar) idempotency_key, (['en', 'de', 'fr'])[user_id % 3 + 1] domain, event_id - event_id % 2 log_id,
      case event_type when 'click' then 'click' when 'purchase' then 'adopt' else 'rate' end kind, case when event_id % 11 <> 0 then user_id end page_id,
      case when event_type = 'signup' then cast(event_id % 7 as integer) end rating, props metadata_json, ts received_at
      from events where event_type in ('click', 'purchase', 'signup'))""",
    "vectors": """vectors as (select vec_id id, cast(embedding as double[]) vec, 'v:label:' || cast(label as varchar) entity_id, label from embeddings)""",
}


def ctes(*names: str) -> str:
    return "with " + ",\n".join(CTES[n] for n in names)
