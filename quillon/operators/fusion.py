"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def candidate_depth(k: int, multiplier: int) -> int:
    return min(max(k * multiplier, 50), 500)


def rrf(lists: list[DataFrame], k: int, by: list[str] | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Fuse ranked lists of (page_id, score): sum of 1 / (rrf_k + rank), best k, ties to the smaller page. by: further keys (a batch of queries)."""
    by = by or []
    ranked = []
    for i, one in enumerate(lists):
        w = W.partitionBy(*by).orderBy(F.desc("score"), "page_id") if by else W.partitionBy(F.lit(i)).orderBy(F.desc("score"), "page_id")
        ranked.append(one.select(*by, "page_id", (1.0 / (rrf_k + F.row_number().over(w))).alias("part")))
    fused = reduce(DataFrame.unionByName, ranked).groupBy(*by, "page_id").agg(F.round(F.sum("part"), 9).alias("score"))
    if not by:
        return fused.orderBy(F.desc("score"), "page_id").limit(k)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "page_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)
