"""Packs, intents, published tables, reports, lease timers."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import filters as FL
from quillon.operators import qug as Q
from quillon.sources import packs as P
from quillon.sources import sinks as K
from quillon.streaming import streams as ST

INTENTS = """
intents:
  - {id: cold, phrases: [iced, Cold  Ones], expansion: {text: Ice Drink}}
  - {id: sweet, phrases: [not sweet], attribute: {field: sugar, max: 30}}
  - {id: one, phrases: [exactly], attribute: {field: sugar, equals: 5}}
  - {id: none, phrases: [no pearls], negation: {field: parts, refs: [pearl]}}
"""


def test_intents(spark):
    found = P.parse_intents(INTENTS, {"sugar": "numeric"})
    assert [i.kind for i in found] == ["intent_template", "attribute", "attribute", "negation"]
    assert found[2].conditions == [FL.NumericRange("sugar", 5, 5)]
    edges = {(r.src, r.dst, r.kind) for r in P.intent_edges(spark, found).collect()}
    assert ("cold ones", "ice drink", "intent_template") in edges and ("no pearls", "no pearls", "negation") in edges
    for bad in ("intents: [{id: a, phrases: []}]", "intents: [{id: a, phrases: [x]}]", "intents: [{id: a, phrases: [x], expansion: {}, negation: {}}]"):
        with pytest.raises(ValueError):
            P.parse_intents(bad)


def test_rewrite_with_intents(spark):
    edges = spark.createDataFrame([("tea", "drink", "synonym", "h")], "src string, dst string, kind string, edge_hash string")
    found = P.parse_intents(INTENTS)
    out = Q.rewrite_with_intents("Iced tea, no pearls", edges, found, [FL.RefContains("parts", ("pearl", "jelly"))])
    assert out["status"] == "applied" and out["terms"] == ["iced tea, no pearls", "drink", "iced", "no pearls", "ice drink"] or "drink" in out["terms"] and "ice drink" in out["terms"]
    assert FL.RefContains("parts", ("jelly",)) in out["conditions"] and FL.RefExcludes("parts", ("pearl",)) in out["conditions"]
    assert Q.rewrite_with_intents("nothing", edges, found, [])["status"] == "fallback"


def test_pack(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "domain.yaml").write_text("name: b\nversion: '1.0.0'\nentities: [{fields: [{name: p, field_type: numeric}, {name: d, field_type: text, filterable: false}]}]\nquery: {filters: [p]}\n")
    assert [p.name for p in P.find_packs(str(tmp_path))] == ["b"]
    (tmp_path / "a" / "domain.yaml").write_text("name: b\nversion: '1.0.0'\nentities: [{fields: [{name: d, field_type: text, filterable: false}]}]\nquery: {filters: [d]}\n")
    with pytest.raises(ValueError):
        P.find_packs(str(tmp_path))


def test_quota_gaps(spark):
    rows = [("synonym",)] * 25 + [("intent",)] * 3
    got = {r.kind: r.n for r in P.quota_gaps(spark.createDataFrame(rows, "kind string")).collect()}
    assert got == {"intent": 3, "negation": 0, "attribute_filter": 0, "negative": 0}


def test_published_table(spark, tmp_path):
    table = K.PublishedTable(spark, f"file://{tmp_path}/t")
    assert table.current() is None
    one, two = spark.range(5), spark.range(7)
    assert table.publish(one) == (1, "published") and table.publish(one) == (1, "reused")
    assert table.publish(two) == (2, "published")
    generation, df = table.current()
    assert generation == 2 and df.count() == 7
    assert table.publish(two, force=True) == (3, "published")


def test_report(spark):
    a = K.report({"x": spark.range(3)})
    assert a == K.report({"x": spark.range(3).orderBy(F.desc("id"))}) and "| id |" in K.markdown(a)
    with pytest.raises(ValueError):
        K.report({"x": spark.range(1001)})
    with pytest.raises(ValueError):
        K.canonical_json({"x": float("nan")})


def test_pointer(spark):
    df = spark.createDataFrame([('{"fields": {"a/b": ["x", "y"], "n": 5, "it\'s": "q"}}',)], "j string")
    get = lambda p: df.select(S.resolve_pointer(F.col("j"), p).alias("v")).first().v
    assert get("/fields/a~1b/1") == "y" and get("/fields/n") is None and get("/fields/none") is None and get("/fields/it's") == "q"


def test_lease_timers(spark, tmp_path):
    rows = [(1, "claim", 0), (1, "beat", 200), (1, "done", 450), (2, "claim", 0), (2, "beat", 400), (3, "claim", 0), (9, "claim", 10_000)]
    df = spark.createDataFrame(rows, "task_id long, kind string, s long").select("task_id", "kind", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    got = {(r.task_id, r.outcome, r.at - 1_000_000) for r in ST.drain(ST.lease_timers(ST.read_stream(spark, f"{tmp_path}/e"))).collect()}
    assert {(1, "done", 450.0), (2, "expired", 300.0)} <= got
    assert {x for x in got if x[0] == 3} <= {(3, "expired", 300.0)} and not any(x[0] == 9 for x in got)


def test_append_log_ids(spark, tmp_path):
    from quillon.sources.sinks import AppendLog

    log = AppendLog(spark, f"file://{tmp_path}/log", "log_id")
    for n in (5, 0, 7):
        log.append(spark.range(n).repartition(3).withColumnRenamed("id", "x"))
    rows = log.read().collect()
    assert len({r.log_id for r in rows}) == len(rows) == 12
    assert {r.log_id >> 45 for r in rows} == {0, 2}


def test_vector_collection(spark, tmp_path):
    from quillon.sources.sinks import VectorCollection

    store = VectorCollection(spark, f"file://{tmp_path}/v", 2)
    store.ensure()
    points = "id bigint, vec array<double>, entity_id string"
    store.upsert(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], points))
    store.ensure()
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(3, [1.0], "c")], points))
    store.upsert(spark.createDataFrame([(2, [1.0, 1.0], "b")], points))
    assert [(r.id, r.score) for r in store.search([1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.707107)]
    store.delete(spark.createDataFrame([(1,)], "id bigint"))
    assert [r.id for r in store.points().collect()] == [2]
    store.recreate()
    assert store.points().count() == 0


def test_report_files(spark, tmp_path):
    from quillon.sources.sinks import report, write_report

    doc = report({"rows": spark.range(2)})
    for _ in range(2):
        write_report(spark, doc, f"file://{tmp_path}/r", {"rows": "Zeilen"})
    assert json.loads((tmp_path / "r.json").read_text()) == doc
    assert (tmp_path / "r.md").read_text().startswith("## Zeilen") and not list(tmp_path.glob("*.part"))


def test_claim_ends_at_what_does_not_fit(spark):
    from quillon.operators.compiling import claim

    rows = [("d", 1, 1, 0, 5, 0), ("d", 2, 1, 0, 5, 9), ("d", 3, 1, 0, 1, 0)]
    tasks = spark.createDataFrame([(*r, "pending") for r in rows], "domain string, task_id int, next_attempt_at int, retry_count int, cost int, reserved int, status string")
    ids = lambda **how: [r.task_id for r in claim(tasks, 5, 10, 100, **how).orderBy("task_id").collect()]
    assert ids() == [1, 2, 3]
    assert ids(task_budget=10) == [1]
    assert ids(day_budget=20, day_used=10) == [1, 2]


def test_search_needs_facts(spark):
    from quillon.operators.filters import TextEquals
    from quillon.plans.search import Query, search

    with pytest.raises(ValueError):
        search(spark.createDataFrame([], "page_id long, title string, content string, status string, domain string"), Query("x", [TextEquals("a", "b")]))
