"""Windows over several batches: the last update of a window stays, and rows behind the watermark are left out."""

from datetime import datetime

import pytest

from quillon.streaming.streams import drain, rate_windows

SCHEMA = "key string, ts timestamp"


def test_windows_over_batches(spark, tmp_path):
    at = lambda h, m: datetime(2025, 3, 1, h, m)
    batches = [[("a", at(1, 5)), ("a", at(1, 10)), ("b", at(1, 20))], [("a", at(1, 40)), ("b", at(5, 0))], [("a", at(1, 50)), ("b", at(5, 30))], [("a", at(1, 55)), ("b", at(5, 40))]]  # Spark holds rows against the watermark of the batch before
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r.window_start.hour, r.key): (r.requests, r.refused) for r in drain(rate_windows(stream, 2, "1 hour", "1 hour"), "update", ["window_start", "key"]).collect()}
    assert got == {(1, "a"): (4, 2), (1, "b"): (1, 0), (5, "b"): (3, 1)}


def test_updates_need_keys(spark):
    with pytest.raises(ValueError):
        drain(spark.createDataFrame([], SCHEMA), "update")
