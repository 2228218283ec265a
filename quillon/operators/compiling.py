"""The compile pipeline's decisions: admission, budgets, citation checks, scores, gate, failures, leases.

State changes are pure functions of tables (tasks, heads, pages) and a clock;
a run writes their results as the next generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import RETRY_AFTER_MOST, backoff_seconds, framed_hash, ink, reference_id_valid, reference_markers, render_markdown, semver_key
from ..sources.shared import ROWS_EACH, tasks_for, written

# Default thresholds of the gate, and the limits of a run.
GATE = {"overall": 0.75, "coverage": 0.60, "density": 0.40}
KNOWLEDGE_BYTES = 64 * 1024
LEASE_SECONDS = 300


def prepare(entities: DataFrame, knowledge: list[str]) -> DataFrame:
    """entity_id, source_revision, snapshot (sorted JSON of the knowledge fields), snapshot_hash (with the revision), source_hash (without), preflight reason."""
    fields = sorted(knowledge)
    snapshot = F.to_json(F.struct(*[F.col(f) for f in fields]))
    units = sum((F.coalesce(F.length(F.col(f).cast("string")) > 0, F.lit(False)).cast("int") for f in fields), F.lit(0))
    preflight = F.when(units == 0, "no_units").when(F.octet_length(snapshot) > KNOWLEDGE_BYTES, "too_large")
    return entities.select("entity_id", "source_revision", snapshot.alias("snapshot"), framed_hash("snapshot", F.col("entity_id"), F.col("source_revision"), snapshot).alias("snapshot_hash"), framed_hash("source", F.col("entity_id"), snapshot).alias("source_hash"), preflight.alias("preflight"))


def coverable_units(entities: DataFrame, fields: list[str]) -> DataFrame:
    """entity_id, pointer, value: the non-empty string leaves; list fields give one per element."""
    kinds = dict(entities.dtypes)

    def leaf(f: str) -> Column:
        if not kinds[f].startswith("array"):
            return F.array(F.struct(F.lit(f"/fields/{f}").alias("pointer"), F.col(f).cast("string").alias("value")))
        return F.coalesce(F.transform(F.col(f), lambda x, i: F.struct(F.concat(F.lit(f"/fields/{f}/"), i.cast("string")).alias("pointer"), x.alias("value"))), F.array().cast("array<struct<pointer:string,value:string>>"))

    leaves = [leaf(f) for f in sorted(fields)]
    return entities.select("entity_id", F.explode(F.filter(F.concat(*leaves), lambda x: F.length(x["value"]) > 0)).alias("u")).select("entity_id", "u.*")


def admit(sources: DataFrame, heads: DataFrame, pages: DataFrame, tasks: DataFrame, artifact: str, force: bool = False) -> DataFrame:
    """sources with their admission: rejected, skipped, queued, queued_epoch or inserted.

    heads: entity_id, head_revision, head_snapshot. pages (accepted): entity_id, page_hash, page_artifact.
    tasks: entity_id, task_status, task_hash, task_revision.
    """
    rev, head = F.col("source_revision"), F.col("head_revision")
    n = tasks_for(sources.sparkSession, sources.count(), joined=True)
    sources, heads, pages, tasks = (df.repartition(n, "entity_id") for df in (sources, heads, pages, tasks))
    joined = sources.join(heads, "entity_id", "left").join(pages, "entity_id", "left").join(tasks, "entity_id", "left")
    same_task = F.col("task_hash") == F.col("source_hash")
    waiting = F.col("task_status").isin("pending", "running")
    current = (F.col("page_hash") == F.col("source_hash")) & (F.col("page_artifact") == artifact)
    decision = (
        F.when(rev < head, "skipped")
        .when((rev == head) & (F.col("head_snapshot") != F.col("snapshot_hash")), "rejected")
        .when(F.lit(not force) & F.coalesce(current, F.lit(False)), "skipped")
        .when(F.col("task_status").isNull(), "inserted")
        .when(F.lit(force) | ~same_task, "queued_epoch")
        .when(waiting & (rev > F.col("task_revision")), "queued")
        .otherwise("skipped")
    )
    return joined.select("entity_id", "source_revision", decision.alias("admission"))


def claim(tasks: DataFrame, now: int, most_tasks: int, run_budget: int, retries: int = 3, shards: list[str] | None = None, task_budget: int | None = None, day_budget: int | None = None, day_used: int = 0) -> DataFrame:
    """The longest prefix of due tasks, by (next_attempt_at, task_id), in which every task fits three budgets; with their lease's end.

    A task fits if what it has reserved before and its cost stay within the task's budget,
    the running cost within the run's, and that with what the UTC day has used within the day's.
    The first that doesn't fit ends the claim. A queue is claimed per shard (a domain): the order
    and the budgets are the shard's. tasks may have a column `reserved`.
    """
    keys = shards or ["domain"]
    due = tasks.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now) & (F.col("retry_count") < retries))
    most = run_budget if day_budget is None else min(run_budget, day_budget - day_used)
    reserved = F.coalesce("reserved", F.lit(0)) if "reserved" in tasks.columns else F.lit(0)
    own = F.lit(True) if task_budget is None else reserved + F.col("cost") <= task_budget
    # A shard may be the whole queue: each range of it sums for itself, on top of what the shard's ranges before it come to.
    n = tasks_for(tasks.sparkSession, due.count())
    dealt = due.select(*keys, "next_attempt_at", "task_id", "cost", own.cast("int").alias("own")).repartitionByRange(n, *keys, "next_attempt_at", "task_id")
    dealt = written(dealt.withColumn("range", F.spark_partition_id()), "due")
    parts = dealt.groupBy(*keys, "range").agg(F.sum("cost").alias("cost"), F.count("*").alias("rows"), F.min("own").alias("own"))
    before = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("range").alias("_range"), F.sum("cost").over(before).alias("_cost"), F.sum("rows").over(before).alias("_rows"), F.min("own").over(before).alias("_own")).where("_rows > 0")
    w = W.partitionBy(*keys, "range").orderBy("next_attempt_at", "task_id")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = dealt.repartition(n, *keys, "range").withColumns({"q_sum": F.sum("cost").over(so_far), "q_place": F.row_number().over(w), "q_fit": F.min("own").over(so_far)})
    same = F.col("range") == F.col("_range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    seen = seen.join(F.broadcast(parts), same, "left")  # at most a row a range
    seen = seen.withColumns({"running": F.coalesce(F.col("q_sum") + F.col("_cost"), "q_sum", "_cost"), "place": F.col("q_place") + F.coalesce("_rows", F.lit(0)), "all_fit": F.least("q_fit", "_own")})
    return seen.where((F.col("running") <= most) & (F.col("place") <= most_tasks) & (F.col("all_fit") == 1)).select(*keys, "task_id", "cost", "running", F.lit(now + LEASE_SECONDS).alias("lease_until"))


def check_refs(refs: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """refs with their issues (array of codes) and whether they are valid.

    refs: page_id, section, ref_id, ref_entity, ref_revision, pointer, value, quote. units: entity_id, pointer, value.
    sources: page_id, entity_id, source_revision. Each step's rows are dealt to tasks by the number of refs (which is counted first).
    """
    n = tasks_for(refs.sparkSession, refs.count(), joined=True)
    twice = F.count("*").over(W.partitionBy("page_id", "ref_id")) > 1
    seen = refs.repartition(n, "page_id").withColumn("known", reference_id_valid(F.col("ref_id")) & ~twice).join(sources.repartition(n, "page_id"), "page_id")
    leaf = units.select("entity_id", "pointer", F.col("value").alias("leaf"))
    seen = seen.repartition(n, "entity_id", "pointer").join(leaf.repartition(n, "entity_id", "pointer"), ["entity_id", "pointer"], "left")
    code = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    known = F.col("known")
    broken = [
        code(known & F.col("leaf").isNull(), "POINTER_MISSING"),
        code(known & (F.col("leaf") != F.col("value")), "VALUE_MISMATCH"),
        code(known & F.col("leaf").isNotNull() & ((F.coalesce(F.col("quote"), F.lit("")) == "") | ~F.contains(F.col("leaf"), F.col("quote"))), "QUOTE_MISMATCH"),
    ]
    marks = [
        code(~known, "UNKNOWN_REF"),
        code(known & (F.col("ref_entity") != F.col("entity_id")), "ENTITY_MISMATCH"),
        code(known & (F.col("ref_revision") != F.col("source_revision")), "REVISION_MISMATCH"),
    ]
    valid = known
    for b in broken:
        valid = valid & b.isNull()
    return seen.select("page_id", "section", "ref_id", "entity_id", "pointer", "quote", F.array_compact(F.array(*marks, *broken)).alias("issues"), valid.alias("valid"))


def check_assertions(assertions: DataFrame, checked: DataFrame, required: bool = True) -> DataFrame:
    """assertions with their issue and whether they are supported: all refs valid and of the same section, the text equal to the quotes joined by a space.

    assertions: page_id, section, position, text, ref_ids. Each step's rows are dealt to tasks by the number of checked refs and of assertions.
    """
    n = tasks_for(checked.sparkSession, max(checked.count(), assertions.count()), joined=True)
    each = assertions.select("page_id", "section", "position", F.posexplode_outer("ref_ids").alias("i", "ref_id"))
    by_ref, by_place = ["page_id", "section", "ref_id"], ["page_id", "section", "position"]
    found = each.repartition(n, *by_ref).join(checked.where("valid").select("page_id", "section", "ref_id", "quote").repartition(n, *by_ref), by_ref, "left")
    told = found.repartition(n, *by_place).groupBy("page_id", "section", "position").agg(F.count("ref_id").alias("refs"), F.count("quote").alias("good"), F.array_sort(F.collect_list(F.struct("i", "quote"))).alias("quotes"))
    text = F.array_join(F.transform("quotes", lambda q: q["quote"]), " ")
    issue = (
        F.when(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)) | F.coalesce(F.col("text").rlike(r"[\r\n]"), F.lit(False)), "ASSERTION_UNSUPPORTED")
        .when(F.col("refs") == 0, F.when(F.lit(required), "MISSING_REF"))
        .when(F.col("good") < F.col("refs"), "UNKNOWN_REF")
        .when(F.col("text") != text, "ASSERTION_UNSUPPORTED")
    )
    return assertions.repartition(n, *by_place).join(told, by_place, "left").select("page_id", "section", "position", "text", "ref_ids", issue.alias("issue"), (issue.isNull() & (F.col("refs") > 0)).alias("supported"))


def ref_report(refs: DataFrame, assertions: DataFrame) -> DataFrame:
    """Per page: the counts that scores need, from checked refs and assertions, whose number says to how many tasks their rows are dealt."""
    n, by_ref = tasks_for(refs.sparkSession, max(refs.count(), assertions.count()), joined=True), ["page_id", "section", "ref_id"]
    supported = assertions.where("supported").select("page_id", "section", F.explode("ref_ids").alias("ref_id")).repartition(n, *by_ref).join(refs.repartition(n, *by_ref), by_ref)
    refs, assertions = refs.repartition(n, "page_id"), assertions.repartition(n, "page_id")
    covered = supported.select("page_id", "pointer").repartition(n, "page_id").groupBy("page_id").agg(F.count_distinct("pointer").alias("covered"))
    by_assertion = assertions.groupBy("page_id").agg(F.count("*").alias("assertions"), F.sum(F.col("supported").cast("long")).alias("supported"), F.sum(ink(F.col("text"))).cast("long").alias("total_chars"), F.sum(F.when(F.col("supported"), ink(F.col("text"))).otherwise(0)).cast("long").alias("information_chars"), F.count("issue").alias("assertion_issues"))
    by_ref = refs.groupBy("page_id").agg(F.count("*").alias("refs"), F.sum(F.col("valid").cast("long")).alias("valid_refs"), F.sum(F.size("issues")).cast("long").alias("ref_issues"))
    return by_assertion.join(by_ref, "page_id", "left").join(covered, "page_id", "left").select("page_id", "assertions", "supported", "total_chars", "information_chars", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("refs", "valid_refs", "covered")], (F.col("assertion_issues") + F.coalesce("ref_issues", F.lit(0))).alias("issues"))


def scores(report: DataFrame, n_units: DataFrame, schema_valid: Column | None = None, consistency: Column | None = None) -> DataFrame:
    """coverage, citation, density, schema, overall of each page; all zero where the schema fails. n_units: page_id, units."""
    ok = F.lit(True) if schema_valid is None else schema_valid
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    joined = report.join(n_units, "page_id", "left")
    citation = F.when((F.col("assertions") > 0) & (F.col("refs") > 0), F.least(F.col("supported") / F.col("assertions"), F.col("valid_refs") / F.col("refs"))).otherwise(0.0)
    density = F.when(F.col("total_chars") > 0, F.least("information_chars", "total_chars") / F.col("total_chars")).otherwise(0.0)
    single = lambda c: F.when(ok, c).otherwise(0.0).cast("float")
    out = joined.select("page_id", "issues", single(ratio("covered", "units")).alias("coverage"), single(citation).alias("citation"), single(density).alias("density"), single(F.lit(1.0)).alias("schema"), (F.lit(None) if consistency is None else consistency).cast("float").alias("consistency"))
    four = F.col("coverage") + F.col("citation") + F.col("density") + F.col("schema")
    return out.withColumn("overall", F.when(F.col("consistency").isNull(), four / 4).otherwise((four + F.col("consistency")) / 5).cast("float"))


def gate(scored: DataFrame) -> DataFrame:
    """scored with accepted: no issue, thresholds reached (they pass when met exactly), schema and citation whole."""
    f = lambda x: F.lit(x).cast("float")
    passes = (F.col("issues") == 0) & (F.col("overall") >= f(GATE["overall"])) & (F.col("coverage") >= f(GATE["coverage"])) & (F.col("density") >= f(GATE["density"])) & (F.col("schema") == 1) & (F.col("citation") == 1)
    return scored.withColumn("accepted", passes)


def dispose(failures: DataFrame, recompiles: int = 2, retries: int = 3) -> DataFrame:
    """What becomes of failed attempts (kind invalid, retryable or permanent; counts so far; retry_after): status, result, wait, review."""
    kind, n, again = F.col("kind"), F.col("recompile_count"), F.col("retry_count")
    dead = (kind == "invalid") & (n > recompiles) | (kind == "retryable") & (again >= retries)
    waits = F.when(kind == "retryable", F.coalesce(F.when(F.col("retry_after").between(0, RETRY_AFTER_MOST), F.col("retry_after")).cast("long"), backoff_seconds(again + 1))).otherwise(backoff_seconds(n))
    return failures.select(
        "task_id",
        F.when(kind == "permanent", "failed").when(dead, "dead").otherwise("pending").alias("status"),
        F.when(kind == "permanent", "failed").when(dead & (kind == "invalid"), "quarantined").when(dead, "failed").alias("result"),
        F.when((kind != "permanent") & ~dead, waits).alias("wait_seconds"),
        dead.alias("review"),
    )


def recover(tasks: DataFrame, heads: DataFrame, now: int, retries: int = 3) -> DataFrame:
    """Running tasks whose lease is over: superseded (the head moved on), dead with a review, or pending after a backoff."""
    lost = tasks.where((F.col("status") == "running") & (F.col("lease_until") < now)).join(heads, "entity_id", "left")
    moved = F.coalesce(F.col("head_hash") != F.col("source_hash"), F.lit(False))
    out = F.when(moved, "superseded").when(F.col("retry_count") + 1 >= retries, "dead").otherwise("pending")
    return lost.select("task_id", out.alias("outcome"), F.when(out == "pending", F.lit(now) + backoff_seconds(F.col("retry_count") + 1)).alias("next_attempt_at"), (out == "dead").alias("review"))


def consistency(claims: DataFrame) -> DataFrame:
    """Per (entity_id, pointer): occurrences, values and whether they agree. claims: page_id, entity_id, pointer, value; a page's equal values count once."""
    rows = claims.select("page_id", "entity_id", "pointer", "value", F.pmod(F.xxhash64("page_id"), F.lit(8)).alias("part"))  # a frequent pointer is eight tasks'
    n = tasks_for(claims.sparkSession, rows.count(), 2 * ROWS_EACH)
    each = rows.repartition(n, "entity_id", "pointer", "part").distinct().groupBy("entity_id", "pointer", "value", "part").agg(F.count("*").alias("pages"))
    groups = each.drop("part").repartition(n, "entity_id", "pointer").groupBy("entity_id", "pointer").agg(F.sum("pages").alias("occurrences"), F.count_distinct("value").alias("n_values"), F.min("value").alias("least_value"))
    return groups.where("occurrences >= 2").withColumn("agrees", F.col("n_values") == 1)


@dataclass(frozen=True)
class Range:
    """at least `low`, below `high` (either may be None)."""

    low: str | None = None
    high: str | None = None


def violations(artifacts: DataFrame, ranges: dict[str, Range], allowed: list[str]) -> DataFrame:
    """artifact_id, component, code (missing, invalid, range, not_allowed). artifacts: artifact_id, artifact, and a version column per component."""
    rows = []
    for name, r in sorted(ranges.items()):
        key = semver_key(F.col(name))
        at = lambda v: F.array(*[F.lit(int(x)) for x in v.split(".")])
        out = F.lit(False)
        if r.low:
            out |= key < at(r.low)
        if r.high:
            out |= key >= at(r.high)
        rows.append(F.struct(F.lit(name).alias("component"), F.when(F.col(name).isNull(), "missing").when(key.isNull(), "invalid").when(out, "range").alias("code")))
    rows.append(F.struct(F.lit("artifact").alias("component"), F.when(~F.coalesce(F.col("artifact").isin(*allowed), F.lit(False)), "not_allowed").alias("code")))
    return artifacts.select("artifact_id", F.explode(F.filter(F.array(*rows), lambda x: x["code"].isNotNull())).alias("v")).select("artifact_id", "v.*")


def mock_evidence(entities: DataFrame, fields: list[str]) -> DataFrame:
    """Deterministic evidence: a section per string leaf, one assertion that quotes it whole.

    entity_id, sections: array of (heading, assertions: array of (text, ref_ids), refs: array of (id, pointer, value, quote)), markdown.
    """
    units = coverable_units(entities, fields)
    w = W.partitionBy("entity_id").orderBy("pointer")
    numbered = units.repartition(tasks_for(units.sparkSession, units.count()), "entity_id").withColumn("k", F.row_number().over(w)).withColumn("ref", F.concat(F.lit("r"), F.col("k").cast("string")))
    section = F.struct(
        F.col("k"),
        F.col("pointer").alias("heading"),
        F.array(F.struct(F.col("value").alias("text"), F.array("ref").alias("ref_ids"))).alias("assertions"),
        F.array(F.struct(F.col("ref").alias("id"), "pointer", "value", F.col("value").alias("quote"))).alias("refs"),
    )
    whole = numbered.groupBy("entity_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    return whole.withColumn("markdown", render_markdown(F.col("sections")))


#: Fixed value: what the mock compiler puts before each assertion of a page of low quality.
LOW_QUALITY_MARK = "低质量改写："
MISSING_SOURCE = "MISSING_SOURCE_REFS"


def mock_outcomes(entities: DataFrame, fields: list[str]) -> DataFrame:
    """entity_id, status (ok, invalid, retryable or permanent), code, retry_after, sections, markdown of the mock compiler's scripts.

    entities also have behavior (normal, low_quality, retryable, permanent), code and retry_after. A page of low quality is well formed,
    but its assertions don't quote their source; a source without a string leaf is invalid. Failures have no evidence.
    """
    script = entities.select("entity_id", "behavior", F.col("code").alias("q_code"), F.col("retry_after").alias("q_after"))
    fails = F.col("behavior").isin("retryable", "permanent")
    spoilt = F.transform("sections", lambda s: s.withField("assertions", F.transform(s["assertions"], lambda a: a.withField("text", F.concat(F.lit(LOW_QUALITY_MARK), a["text"])))))
    whole = script.join(mock_evidence(entities.where(~fails), fields).drop("markdown"), "entity_id", "left")
    whole = whole.withColumn("sections", F.when(F.col("behavior") == "low_quality", spoilt).otherwise(F.col("sections")))
    empty = F.col("sections").isNull()
    return whole.select(
        "entity_id",
        F.when(fails, F.col("behavior")).when(empty, "invalid").otherwise("ok").alias("status"),
        F.when(fails, F.col("q_code")).when(empty, MISSING_SOURCE).alias("code"),
        F.when(F.col("behavior") == "retryable", F.col("q_after")).alias("retry_after"),
        "sections",
        F.when(~empty, render_markdown(F.col("sections"))).alias("markdown"),
    )


def has_existing_data(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row, found: is there an accepted page, or a task pending, running or dead? Each side stops at its first row."""
    live = pages.where("status = 'accepted'").select(F.lit(1).alias("n")).limit(1)
    open_ = tasks.where("status in ('pending', 'running', 'dead')").select(F.lit(1).alias("n")).limit(1)
    return live.unionAll(open_).agg((F.count("*") > 0).alias("found"))


def check_markdown(pages: DataFrame) -> DataFrame:
    """pages (entity_id, sections, markdown) with their marker counts and MARKDOWN_MISMATCH or UNUSED_REF issues.

    The markers must be the assertions' references in order and the text the canonical rendering; a reference that no assertion of its section names is unused.
    """
    named = F.flatten(F.flatten(F.transform("sections", lambda s: F.transform(s["assertions"], lambda a: a["ref_ids"]))))
    unused = F.flatten(F.transform("sections", lambda s: F.array_except(F.transform(s["refs"], lambda r: r["id"]), F.flatten(F.transform(s["assertions"], lambda a: a["ref_ids"])))))
    markers = reference_markers(F.col("markdown"))
    issues = F.array_compact(F.array(F.when((markers != named) | (F.col("markdown") != render_markdown(F.col("sections"))), F.lit("MARKDOWN_MISMATCH")), F.when(F.size(unused) > 0, F.lit("UNUSED_REF"))))
    return pages.select("entity_id", F.size(markers).alias("n_markers"), F.size(named).alias("n_named"), issues.alias("issues"))


def publish(current: DataFrame, compiled: DataFrame, tasks: DataFrame, heads: DataFrame, now: int) -> DataFrame:
    """Pages after a run: a compiled page (entity_id, token, source_hash, content) replaces the current one, a generation on, where its task is still fenced.

    Fenced: running, the same token, the lease not over, the head still the compiled source. current: entity_id, content, generation.
    """
    fence = tasks.where((F.col("status") == "running") & (F.col("lease_until") >= now)).select("entity_id", "token")
    good = compiled.join(fence, ["entity_id", "token"], "left_semi").join(heads.select("entity_id", F.col("head_hash").alias("source_hash")), ["entity_id", "source_hash"], "left_semi")
    before = current.select("entity_id", F.col("generation").alias("before"))
    new = good.join(before, "entity_id", "left").select("entity_id", "content", (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("generation"))
    return current.select("entity_id", "content", F.col("generation").cast("long").alias("generation")).join(new, "entity_id", "left_anti").unionByName(new)


def heartbeat(tasks: DataFrame, beats: DataFrame, now: int) -> DataFrame:
    """Tasks after heartbeats (task_id, token, epoch): a lease is extended only if its token and epoch are live."""
    live = beats.select("task_id", "token", "epoch", F.lit(True).alias("beat")).distinct()
    extend = F.coalesce("beat", F.lit(False)) & (F.col("status") == "running") & (F.col("lease_until") >= now)
    return tasks.join(live, ["task_id", "token", "epoch"], "left").withColumn("lease_until", F.when(extend, F.lit(now + LEASE_SECONDS)).otherwise(F.col("lease_until"))).drop("beat")


def run_stats(outcomes: DataFrame) -> DataFrame:
    """One row: a count per outcome."""
    names = ("accepted", "quarantined", "failed", "skipped", "superseded", "rejected", "queued")
    return outcomes.agg(*[F.count(F.when(F.col("outcome") == n, 1)).alias(n) for n in names], F.count("*").alias("total"))
