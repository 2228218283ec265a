"""Structured Streaming: idempotent ingestion, log windows, rate limits, lease timers.

Each function maps a stream to a stream; `drain` runs one to the end of its
input (availableNow) into Parquet and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import shared_path


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder (or file) of Parquet as a stream; event times must be instants, so local times are read in the session's zone."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a glob may name one file, a plain path may not
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def dedup_feedback(events: DataFrame, delay: str = "3650 days") -> DataFrame:
    """Events once per (domain, idempotency_key) within the watermark."""
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["domain", "idempotency_key"])


def log_windows(logs: DataFrame, size: str = "1 day", delay: str = "0 seconds") -> DataFrame:
    """Tumbling windows of the query log by domain: queries, zero-hit queries, failures."""
    w = F.window("ts", size)
    counts = logs.withWatermark("ts", delay).groupBy(w, "domain").agg(F.count("*").alias("queries"), F.sum((F.col("hit_count") == 0).cast("long")).alias("zero_hits"), F.sum(F.col("rewrite_failure").cast("long")).alias("failures"))
    return counts.select(F.col("window.start").alias("window_start"), "domain", "queries", "zero_hits", "failures")


def rate_windows(events: DataFrame, limit: int, size: str = "1 minute", delay: str = "0 seconds") -> DataFrame:
    """Requests per key in fixed windows, and how many of them the limit refuses."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "key").agg(F.count("*").alias("requests"))
    return counts.select(F.col("window.start").alias("window_start"), "key", "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("refused"))


def drain(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Everything that the stream gives for the input that is there now.

    Appended results are added batch by batch; of updated ones (with their keys) the last batch's row stays, so that state needs to
    hold only what the watermark leaves open. The checkpoint is in the shared folder, so a lost driver goes on from it.
    """
    if (mode == "update") != bool(keys):
        raise ValueError("updates need keys, and only they do")
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/q_batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not keys:
        return spark.read.schema(schema).parquet(f"{path}/out/*")
    found = spark.read.schema(StructType([*schema.fields, StructField("q_batch", LongType())])).parquet(f"{path}/out")
    rest = [c for c in schema.names if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "q_batch").alias("q_last"))
    return last.select(*keys, *[F.col(f"q_last.{c}").alias(c) for c in rest])


LEASE = "task_id long, outcome string, at double"


def lease_timers(events: DataFrame, seconds: int = 300) -> DataFrame:
    """task_id, outcome, at: leases as a stream. events: task_id, kind (claim, beat, done), ts in order of arrival.

    A claim opens a lease, a beat extends it, done closes it; one that passes its
    end in event time, by the watermark, expires. State is one number per task.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], "expired", state.get[0]))
            state.remove()
        else:
            until = state.get[0] if state.exists else None
            for frame in frames:
                for kind, ts in frame.sort_values("ts")[["kind", "ts"]].itertuples(index=False):
                    at = ts.timestamp()
                    if until is not None and at > until:
                        out.append((key[0], "expired", until))
                        until = None
                    if kind == "claim" or kind == "beat" and until is not None:
                        until = at + seconds
                    elif kind == "done" and until is not None:
                        out.append((key[0], "done", at))
                        until = None
            if until is None:
                if state.exists:
                    state.remove()
            else:
                state.update((until,))
                state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "outcome", "at"])

    return events.withWatermark("ts", "0 seconds").groupBy("task_id").applyInPandasWithState(step, LEASE, "until double", "append", GroupStateTimeout.EventTimeTimeout)
