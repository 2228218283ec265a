"""Retrieval metrics over golden queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAIN_POINTS = 5.0


def metrics(runs: DataFrame, k: int) -> DataFrame:
    """kind (null: all), samples, recall, negative_precision. runs: kind, hits, expected, must_exclude (arrays).

    Samples without expected hits are left out of recall, those without exclusions out of negative precision; either is null if nothing is left.
    """
    top = F.slice("hits", 1, k)
    recall = F.when(F.size("expected") > 0, F.size(F.array_intersect(top, F.col("expected"))) / F.size("expected"))
    clean = F.when(F.size("must_exclude") > 0, F.when(F.arrays_overlap(top, F.col("must_exclude")), 0.0).otherwise(1.0))
    return runs.select("kind", recall.alias("r"), clean.alias("p")).rollup("kind").agg(F.count("*").alias("samples"), F.round(F.avg("r"), 9).alias("recall"), F.round(F.avg("p"), 9).alias("negative_precision"))


def decide(base: float | None, graph: float | None, active: bool, rewritten: int) -> dict:
    """Whether the graph is worth its while: five points of recall or more, an active graph, and a rewritten sample at least."""
    gain = None if base is None or graph is None else (graph - base) * 100
    return {"gain_points": gain, "enabled": bool(active and rewritten > 0 and gain is not None and gain >= GAIN_POINTS), "regression": gain is not None and gain < 0}
