"""Edge cases of the engine's operators."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import compiling as C
from quillon.operators import evaluation as E
from quillon.operators import feedback as FB
from quillon.operators import filters as FL
from quillon.operators import fusion as FU
from quillon.operators import lexical as L
from quillon.operators import merge as M
from quillon.operators import qug as Q
from quillon.operators import vectors as V
from quillon.plans.search import Query
from quillon.sources import readers as R


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>' if isinstance(v, list) else 'bigint'}" for k, v in values.items()))
    return row.select(expression.alias("x")).first().x


def test_normalize(spark):
    assert one(spark, S.normalize(F.col("a")), a=" 　Ab\t C ") == "ab c"
    assert one(spark, S.normalize(F.col("a")), a="  ") is None
    assert one(spark, S.normalize(F.col("a")), a="x" * 129) is None
    assert one(spark, S.normalize(F.col("a")), a="x" * 128) == "x" * 128


@pytest.mark.parametrize("key,valid", [("a:b:c", True), ("a:b", False), ("a::c", False), ("é:b:ü", True), ("a:b:c:d", False), ("", False)])
def test_entity_id(spark, key, valid):
    assert one(spark, S.entity_id_valid(F.col("a")), a=key) is valid


def test_occurrences_overlap(spark):
    assert one(spark, S.occurrences(F.col("a"), "aaa"), a="aaAaaa") == 4
    assert one(spark, S.occurrences(F.col("a"), "a.b"), a="a.b axb A.B") == 2


def test_cosine(spark):
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]) == 0
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0]) == 0
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=[2.0, 0.0], b=[1.0, 0.0]) == pytest.approx(1)


def test_backoff(spark):
    got = spark.range(0, 10).select(S.backoff_seconds(F.col("id")).alias("x")).collect()
    assert [r.x for r in got] == [1, 1, 2, 4, 8, 16, 32, 60, 60, 60]


def test_filters(spark):
    facts = spark.createDataFrame([("a", "p", 1.0, None), ("b", "p", 5.0, None), ("a", "c", None, "x"), ("b", "c", None, "y")], "entity_id string, field_name string, value_numeric double, value_text string")
    refs = spark.createDataFrame([("a", "r", "1"), ("a", "r", "2")], "entity_id string, field_name string, ref_value string")
    ids = lambda *c: [r.entity_id for r in FL.entity_filter(facts, refs, list(c)).collect()]
    assert ids(FL.NumericRange("p", 1, 1)) == ["a"]
    assert ids(FL.NumericRange("p")) == ["a", "b"]
    assert ids(FL.RefContains("r", ())) == []
    assert ids(FL.RefContains("r", ("2", "9"))) == ["a"]
    assert ids(FL.RefExcludes("r", ())) == ["a", "b"]
    assert ids(FL.RefExcludes("r", ("1",))) == ["b"]
    assert [r.anchor for r in FL.anchor_scope(facts, refs, [FL.NumericRange("p", 2)], "c").collect()] == ["y"]


def test_filter_merge_and_relax():
    a, b = FL.NumericRange("p", 1, 5), FL.NumericRange("p", 3, None)
    assert FL.merge([a, b]) == [FL.NumericRange("p", 3, 5)]
    assert FL.merge([a, FL.NumericRange("p", 9)]) == [a, FL.NumericRange("p", 9)]
    assert FL.merge([FL.RefContains("r", ("a", "b")), FL.RefExcludes("r", ("b",))])[0].refs == ("a",)
    assert FL.merge([a, a]) == [a]
    assert FL.relax([FL.TextEquals("t", "x"), a]) == [FL.TextEquals("t", "x"), FL.NumericRange("p", 1)]
    assert FL.relax([b]) == []
    assert FL.relax([FL.TextEquals("t", "x")]) is None


def test_filter_grammar():
    assert FL.parse("p<=5, p>=1,t=x,r in=a|b,r not_in=c") == [FL.NumericRange("p", None, 5), FL.NumericRange("p", 1, None), FL.TextEquals("t", "x"), FL.RefContains("r", ("a", "b")), FL.RefExcludes("r", ("c",))]
    for bad in ("t=true", "nothing", "=x"):
        with pytest.raises(ValueError):
            FL.parse(bad)


def test_bm25_clamp_and_short(spark):
    pages = spark.createDataFrame([(i, "t", "abc word" if i < 9 else "word zu", "accepted") for i in range(10)], "page_id long, title string, content string, status string")
    common = L.lexical_topk(pages, ["word"], 20).collect()
    assert len(common) == 10 and all(0 < r.score < 1e-5 for r in common)
    assert [r.score for r in L.lexical_topk(pages, ["zu"], 5).collect()] == [1.0]
    assert L.lexical_topk(pages.where("page_id < 0"), ["word"], 5).collect() == []
    assert L.related_terms("ab", ["abc", "abc", "x" * 300]) == ["abc"]


def test_rrf_ties_and_depth(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "page_id long, score double")
    b = spark.createDataFrame([(2, 9.0), (1, 1.0)], "page_id long, score double")
    assert [r.page_id for r in FU.rrf([a, b], 5).collect()] == [1, 2]
    assert (FU.candidate_depth(1, 1), FU.candidate_depth(100, 20), FU.candidate_depth(20, 5)) == (50, 500, 100)


def test_stale_payload_drops_page(spark):
    pages = spark.createDataFrame([(1, "h", 1, "accepted"), (2, "g", 1, "accepted")], "page_id long, content_hash string, generation long, status string")
    payloads = spark.createDataFrame([(1, "h", 1), (1, "old", 1), (2, "g", 1)], "page_id long, content_hash string, generation long")
    assert [r.page_id for r in V.fresh_pages(payloads, pages).collect()] == [2]


def test_cas_keeps_first_of_equal_revisions(spark):
    writes = spark.createDataFrame([("e", "f", 2, 1, "first"), ("e", "f", 2, 2, "second"), ("e", "f", 1, 0, "old")], "entity_id string, field_name string, source_revision long, arrival long, v string")
    assert [r.v for r in M.cas_facts(writes).collect()] == ["first"]


def test_low_quality_boundaries(spark):
    def events(adopted, total):
        return spark.createDataFrame([(i, 1, "adopt" if i < adopted else "click", None) for i in range(total)], "log_id long, page_id long, kind string, rating int")

    assert FB.low_quality_pages(events(1, 5)).count() == 0  # exactly a fifth
    assert FB.low_quality_pages(events(0, 4)).count() == 0
    assert FB.low_quality_pages(events(0, 5)).count() == 1


def test_gate_boundary(spark):
    scored = spark.createDataFrame([(0, 0.6, 1.0, 0.4, 1.0, 0.75), (0, 0.59, 1.0, 0.5, 1.0, 0.77), (1, 1.0, 1.0, 1.0, 1.0, 1.0)], "issues int, coverage float, citation float, density float, schema float, overall float")
    assert [r.accepted for r in C.gate(scored).collect()] == [True, False, False]


def test_metrics_nulls(spark):
    runs = spark.createDataFrame([("a", [1, 2], [], []), ("a", [1, 2], [1, 9], [])], "kind string, hits array<int>, expected array<int>, must_exclude array<int>")
    row = E.metrics(runs, 2).where("kind is null").first()
    assert (row.samples, row.recall, row.negative_precision) == (2, 0.5, None)
    assert E.decide(0.25, 0.3125, True, 1)["enabled"] and not E.decide(0.25, 0.3125, True, 0)["enabled"]


def test_paths_are_simple(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = {"".join(r.nodes) for r in Q.paths(edges, spark.createDataFrame([("a",)], "phrase string"), 4).collect()}
    assert got == {"ab", "abc"}


def test_query_bounds():
    for bad in (Query("x" * 4097), Query("x", top_k=0), Query("x", top_k=101)):
        with pytest.raises(ValueError):
            bad.check()


def test_strict_reader(spark, tmp_path):
    lines = ['{"entity_id":"a:b:1","n":1.5,"t":"x","l":["p","p"]}', '{"entity_id":"a:b:2","n":"1","t":"x","l":[]}', '{"entity_id":"a:b","n":1,"t":"x","l":[]}', "not json", "", '{"entity_id":"a:b:3","n":2,"t":"y","l":[],"source_revision":4}', '{"entity_id":"a:b:4","n":2,"l":[]}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    fields = [R.Field("n", "numeric"), R.Field("t", "text"), R.Field("l", "reflist")]
    good, bad = R.read_entities(spark, str(tmp_path / "x.jsonl"), fields)
    assert sorted((r.entity_id, r.source_revision, r.n) for r in good.collect()) == [("a:b:1", 1, 1.5), ("a:b:3", 4, 2.0)]
    assert sorted(r.reason for r in bad.collect()) == ["entity_id", "json", "missing:t", "type:n"]
    facts, refs = R.entity_facts(good, fields)
    assert facts.count() == 4 and [r.ref_value for r in refs.collect()] == ["p"]


def test_seed_and_sections(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\npage_id: p1\nentity_id: a:b:c\ntitle: "T"\nentity_type: x\naliases: [one, "two"]\ntags: []\n---\nIntro\n\n## First\nbody\n\n## Second\n')
    page = R.read_seed_pages(spark, str(tmp_path / "a.md"))
    row = page.first()
    assert (row.page_id, row.title, row.aliases, row.tags) == ("p1", "T", ["one", "two"], [])
    got = [(r.heading, r.body) for r in R.split_sections(page).orderBy("position").collect()]
    assert got == [("Introduction", "Intro"), ("First", "body"), ("Second", "")]


def test_golden_problems(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id":"1","query":"q","kind":"synonym","expected_entity_ids":["a:b:1"]}\n{"id":"1","query":"q","kind":"odd","expected_entity_ids":["a:b:2"]}\n')
    known = spark.createDataFrame([("a:b:1",)], "entity_id string")
    _, problems = R.read_golden(spark, str(tmp_path / "g.jsonl"), known)
    assert sorted(r.problem for r in problems.collect()) == ["duplicate", "kind", "unknown_entity"]


def test_hashed_embedding_is_one_pass(spark):
    texts = ["", None, "a", "aab", "日本語 straße", "aa" * 40]
    hashes = {r.c: r.h for r in spark.createDataFrame([(c,) for c in sorted({c for t in texts for c in t or ""})], "c string").select("c", F.xxhash64("c").alias("h")).collect()}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for dims in (1, 3, 16):
        for r in df.select("id", S.hashed_embedding(F.col("t"), dims).alias("v")).collect():
            raw = [0.0] * dims
            for c in texts[r.id] or "":
                raw[hashes[c] % dims] += 1.0 if hashes[c] > 0 else -1.0
            n = sum(x * x for x in raw) ** 0.5
            assert r.v == [x / n if n else x for x in raw]
    shown = S.hashed_embedding(F.col("t"), 16)._jc.toString()
    assert shown.count("xxhash64") == 1 and len(shown) < 3000


def dealt_by_rows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_citation_steps_are_dealt_by_rows(spark):
    refs = spark.createDataFrame([(p, 0, f"r{p}", f"e{p}", 1, "/fields/a", "v", "v") for p in range(1, 9)], "page_id int, section int, ref_id string, ref_entity string, ref_revision int, pointer string, value string, quote string")
    sources = refs.selectExpr("page_id", "ref_entity entity_id", "ref_revision source_revision")
    units = refs.selectExpr("ref_entity entity_id", "pointer", "value")
    assertions = refs.selectExpr("page_id", "section", "page_id % 2 position", "value text", "array(ref_id) ref_ids")
    small = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(small)
    spark.conf.set(small, "-1")
    try:
        checked = C.check_refs(refs, units, sources)
        assert dealt_by_rows(checked)
        told = C.check_assertions(assertions, checked.localCheckpoint())
        assert dealt_by_rows(told)
        report = C.ref_report(checked.localCheckpoint(), told.localCheckpoint())
        assert dealt_by_rows(report)
        assert {(r.refs, r.valid_refs, r.covered, r.supported, r.issues) for r in report.collect()} == {(1, 1, 1, 1, 0)}
    finally:
        spark.conf.set(small, before)


def test_consistency_is_dealt_by_rows(spark):
    rows = [(p, "e", "/a", "x" if p < 50 else None) for p in range(60)] * 2 + [(1, "f", "/a", "x"), (2, "f", "/a", "y"), (1, "g", "/a", "x")]
    got = C.consistency(spark.createDataFrame(rows, "page_id int, entity_id string, pointer string, value string"))
    assert dealt_by_rows(got)
    assert {tuple(r) for r in got.collect()} == {("e", "/a", 60, 1, "x", True), ("f", "/a", 2, 2, "x", False)}


def test_claim_of_one_long_shard(spark):
    rows = [("d" if k % 7 else None, k, k * 31 % 50, "pending", 0, None if k % 11 == 0 else k % 5 + 1) for k in range(1, 400)]
    tasks = spark.createDataFrame(rows, "domain string, task_id int, next_attempt_at int, status string, retry_count int, cost int")
    claimed = C.claim(tasks, 40, 150, 400, task_budget=5)
    assert "REPARTITION_BY_NUM" in claimed._jdf.queryExecution().executedPlan().toString()
    want = set()
    for domain in ("d", None):
        total = place = 0
        for _, k, _, _, _, cost in sorted((r for r in rows if r[0] == domain and r[2] <= 40), key=lambda r: (r[2], r[1])):
            total, place = total + (cost or 0), place + 1
            if total > 400 or place > 150:
                break
            want.add((domain, k, cost, total))
    assert {(r.domain, r.task_id, r.cost, r.running) for r in claimed.collect()} == want and len(want) > 150
