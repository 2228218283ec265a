"""Retry-After texts, and what the mock compiler makes of its scripts."""

from pyspark.sql import functions as F

from quillon.functions.scalars import retry_after_seconds
from quillon.operators.compiling import LOW_QUALITY_MARK, check_markdown, has_existing_data, mock_outcomes

NOW = 1740787200  # 1 March 2025, midnight


def test_retry_after(spark):
    want = {
        "120": 120, " 7 ": 7, "-5": 0, "301": 300, "+9": 9, "99999999999999999999": None, "": None, "1.5": None,
        "Sat, 01 Mar 2025 00:02:03 GMT": 123, "Sat, 01 Mar 2025 00:00:60 GMT": 60, "Fri, 28 Feb 2025 23:59:59 GMT": 0, "Sat, 29 Feb 2025 00:00:10 GMT": 10,
        "Sat, 01 Mar 2025 00:02:03 UTC": None, "Sat 01 Mar 2025 00:02:03 GMT": None, "Sat, 01 Mai 2025 00:02:03 GMT": None, "Sat, 32 Mar 2025 00:00:00 GMT": None, "Sat, 01 Mar 1969 00:00:00 GMT": None, "Sat, 01 Mar 2025 24:00:00 GMT": None,
    }
    rows = spark.createDataFrame([(t,) for t in want] + [(None,)], "t string").select("t", retry_after_seconds(F.col("t"), F.lit(NOW)).alias("s")).collect()
    assert {r.t: r.s for r in rows} == want | {None: None}


def test_mock_scripts(spark):
    rows = [("a:b:1", "normal", None, None, "one"), ("a:b:2", "low_quality", None, None, "two"), ("a:b:3", "retryable", "HTTP_429", 9, "three"), ("a:b:4", "permanent", "HTTP_401", 9, "four"), ("a:b:5", "normal", None, None, None)]
    entities = spark.createDataFrame(rows, "entity_id string, behavior string, code string, retry_after int, name string")
    out = {r.entity_id[-1]: r for r in mock_outcomes(entities, ["name"]).collect()}
    assert {k: (r.status, r.code, r.retry_after) for k, r in out.items()} == {"1": ("ok", None, None), "2": ("ok", None, None), "3": ("retryable", "HTTP_429", 9), "4": ("permanent", "HTTP_401", None), "5": ("invalid", "MISSING_SOURCE_REFS", None)}
    assert out["2"].sections[0].assertions[0].text == LOW_QUALITY_MARK + "two" and LOW_QUALITY_MARK not in out["1"].markdown
    assert all(out[k].sections is None and out[k].markdown is None for k in "345")
    sound = check_markdown(mock_outcomes(entities, ["name"]).where("status = 'ok'")).collect()
    assert len(sound) == 2 and all(not r.issues for r in sound)


def test_existing_data(spark):
    pages = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    found = lambda p, t: has_existing_data(p, t).first().found
    assert found(pages("accepted"), pages()) and found(pages(), pages("dead")) and not found(pages("candidate"), pages("done"))
