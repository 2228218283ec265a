"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task of `spread` gets, about.
ROWS_EACH = 250_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names for checkpoints; only a session on this machine alone (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, n_rows: int, rows_each: int = ROWS_EACH, joined: bool = False) -> int:
    """How many tasks n_rows rows need: neither splits nor adaptive sizes, which look at packed bytes, bound the rows that a task sorts.

    Sides of a join that are dealt to fewer tasks than the session's shuffles would be dealt again by Spark.
    """
    n = max(spark.sparkContext.defaultParallelism, -(-n_rows // rows_each))
    usual = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions")
    return max(n, int(usual)) if joined else n


def spread(df: DataFrame, *keys: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """df dealt by keys to as many tasks as its rows need; counts df first."""
    return df.repartition(tasks_for(df.sparkSession, df.count(), rows_each), *keys)
