"""The trigram index against a count by hand."""

import pytest
from pyspark.sql import functions as F

from quillon.operators.lexical import lexical_topk
from quillon.sources.trigrams import TrigramIndex, cover, places_of

ROWS = [
    (1, "Alpha beta", "aaaa Straße alpha", "accepted"),
    (2, None, "the alphabet 日本語テキスト", "accepted"),
    (3, "beta", None, "accepted"),
    (4, "alpha", "alpha alpha", "quarantined"),
    (5, "", "", "accepted"),
    (6, "alp", "ha beta", "accepted"),
    (7, "x" * 50, ("needle " * 40) + "needles", "accepted"),
]
SCHEMA = "page_id long, title string, content string, status string"


def brute(term):
    out = {}
    for page, title, content, status in ROWS:
        if status == "accepted":
            n = sum(t.lower().startswith(term.lower(), k) for t in (title or "", content or "") for k in range(len(t)))
            if n:
                out[page] = n
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return TrigramIndex(spark, str(tmp_path_factory.mktemp("index"))).build(spark.createDataFrame(ROWS, SCHEMA))


@pytest.mark.parametrize("term", ["alpha", "beta", "aaa", "ALPHABET", "日本語", "needle", "needle needle", "alpha beta", "xxxx", "pha", "nothing here"])
def test_frequencies(index, term):
    assert {r.page_id: r.f for r in index.frequencies([term]).collect()} == brute(term)


def test_batch_is_each_alone(spark, index):
    terms = ["alpha", "beta", "needles", "日本語テ", "the", "unknown", "al"]
    queries = spark.createDataFrame(list(enumerate(terms)), "query_id int, term string")
    got = {}
    for r in index.batch(queries, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.page_id, r.score))
    pages = spark.createDataFrame(ROWS, SCHEMA)
    for k, term in enumerate(terms):
        want = [(i + 1, r.page_id, r.score) for i, r in enumerate(lexical_topk(pages, [term], 3).collect())] if len(term) > 2 else []
        assert got.get(k, []) == want


def test_topk_with_scope_and_short_terms(spark, index):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    for scope in (None, F.col("page_id") != 1):
        for how in ("max", "sum"):
            want = lexical_topk(pages, ["alpha", "be", "beta"], 5, scope, how).collect()
            assert lexical_topk(pages, ["alpha", "be", "beta"], 5, scope, how, index=index).collect() == want


def test_pieces(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(100))
    pages = spark.createDataFrame([(1, "", text, "accepted"), (2, "", text[:99], "accepted"), (3, "", text[:98], "accepted")], SCHEMA)
    for piece in (1, 7, 98, 99, 100, 1000):
        got = sorted((r.page_id, r.at - (1 << 30), r.gram) for r in places_of(pages, piece).collect())
        assert got == sorted((p, k, text[k : k + 3]) for p, n in ((1, 100), (2, 99), (3, 98)) for k in range(n - 2))


def test_no_text_is_read(index):
    plan = index.frequencies(["than the"])._jdf.queryExecution().toString()
    assert "content" not in plan and "title" not in plan and "In(gram" in plan


def test_empty_and_missing(spark, tmp_path):
    fresh = TrigramIndex(spark, str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        fresh.frequencies(["alpha"])
    fresh.build(spark.createDataFrame([], SCHEMA))
    assert fresh.hits(["alpha"]).collect() == []
    assert fresh.batch(spark.createDataFrame([(1, "alpha")], "query_id int, term string"), 3).collect() == []


def test_new_generation(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "again"))
    index.build(spark.createDataFrame(ROWS[:1], SCHEMA))
    assert index.frequencies(["beta"]).count() == 1
    index.build(spark.createDataFrame(ROWS, SCHEMA))
    assert index.frequencies(["beta"]).count() == 3


def test_cover():
    assert all({c + i for c in cover("x" * n) for i in range(3)} == set(range(n)) for n in range(3, 30))


def test_build_deals_pages_not_places(spark, tmp_path):
    """A page's places are in one file, whatever their trigrams: no place was shuffled."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = [(k, f"title {k}", " ".join(str(k * j) for j in range(50)), "accepted") for k in range(40)]
        index = TrigramIndex(spark, str(tmp_path / "dealt")).build(spark.createDataFrame(rows, SCHEMA))
    finally:
        spark.conf.set(name, before)
    files = index.table("places").select("page_id", F.input_file_name().alias("file")).distinct()
    assert files.select("file").distinct().count() > 1 and files.count() == 40


def test_frequencies_deal_rows_by_page_once(index):
    plan = index.frequencies(["alpha beta"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan


def test_batch_deals_out_asked_trigrams_only(spark, index, monkeypatch):
    from quillon.sources import trigrams

    plans, write = {}, trigrams.written
    monkeypatch.setattr(trigrams, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name))
    index.batch(spark.createDataFrame([(1, "alpha"), (2, "beta")], "query_id int, term string"), 3)
    assert plans["frequencies"].count("Join LeftSemi") == 2
