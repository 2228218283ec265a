"""Exact vector retrieval and the stale-payload test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine, dot, euclidean

DISTANCES = {"cosine": cosine, "dot": dot, "euclidean": lambda a, b: F.lit(0.0) - euclidean(a, b)}


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_topk(vectors: DataFrame, query: list[float], k: int, distance: str = "cosine", whitelist: DataFrame | None = None) -> DataFrame:
    """Best k of (id, vec, entity_id) by score, ties to the smaller id; whitelist: entity_id rows. A per-partition top-k, so only k rows a task move."""
    seen = vectors if whitelist is None else vectors.join(whitelist.select("entity_id").distinct(), "entity_id", "left_semi")
    scored = seen.select("id", "entity_id", F.round(DISTANCES[distance](F.col("vec"), literal_vector(query)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def fresh_pages(payloads: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of which every presented payload (page_id, content_hash, generation) is that of an accepted page."""
    live = pages.where("status = 'accepted'").select("page_id", "content_hash", "generation", F.lit(1).alias("live"))
    usable = payloads.withColumn("usable", (F.col("content_hash") != "") & (F.col("generation") > 0))
    return usable.join(live, ["page_id", "content_hash", "generation"], "left").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("usable") & (F.col("live") == 1), 1).otherwise(0)).alias("fit")).where("n = fit").select("page_id")
