"""Latest-wins, keep-first and idempotent writes as pure functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cas_facts(writes: DataFrame) -> DataFrame:
    """Facts after compare-and-set on the revision: the highest revision, of equal ones the first to arrive."""
    return first_by(writes, ["entity_id", "field_name"], [F.desc("source_revision"), F.asc("arrival")])


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace current ones of the same key."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def append_new(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows whose key is not there yet, each key once: what an idempotent append adds."""
    return first_by(new, keys, order).join(current.select(*keys), keys, "left_anti")


def delete(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys), keys, "left_anti")
