"""One compile run: prepare, admit, claim, compile, check, score, gate, publish, account.

The run is a function of tables; each step's rows are written before the next reads them. A compiler is anything that maps sources to
evidence (`mock_evidence` here); everything around it is the run's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compiling as C
from ..operators.merge import first_by
from ..sources.shared import spread, tasks_for, written


@dataclass
class Run:
    pages: DataFrame
    scored: DataFrame
    admissions: DataFrame
    stats: DataFrame


def explode_evidence(evidence: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, assertions) in the flat form that the checks take; a page is its entity."""
    n = tasks_for(sources.sparkSession, sources.count(), joined=True)
    named = evidence.repartition(n, "entity_id").join(sources.select("entity_id", "source_revision").repartition(n, "entity_id"), "entity_id").select(F.col("entity_id").alias("page_id"), "entity_id", "source_revision", F.posexplode("sections").alias("section", "s"))
    refs = named.select("page_id", "section", F.col("entity_id").alias("ref_entity"), F.col("source_revision").alias("ref_revision"), F.explode("s.refs").alias("r")).select("page_id", "section", F.col("r.id").alias("ref_id"), "ref_entity", "ref_revision", "r.pointer", "r.value", "r.quote")
    assertions = named.select("page_id", "section", F.posexplode("s.assertions").alias("position", "a")).select("page_id", "section", "position", "a.text", "a.ref_ids")
    return refs, assertions


def compile_run(entities: DataFrame, knowledge: list[str], current: DataFrame, heads: DataFrame, tasks: DataFrame, artifact: str, now: int, budget: int, order: str = "entity_id", compiler=C.mock_evidence) -> Run:
    """entities: entity_id, source_revision, arrival and the knowledge fields. current: entity_id, content, generation, page_hash, page_artifact.

    heads: entity_id, head_revision, head_snapshot. tasks: entity_id, task_status, task_hash, task_revision.
    """
    once = written(first_by(spread(entities, "entity_id"), ["entity_id"], [F.asc("arrival")]), "once")
    n = tasks_for(once.sparkSession, once.count(), joined=True)
    dealt = lambda df: df.repartition(n, "entity_id")
    sources = C.prepare(once, knowledge)
    sound = sources.where("preflight is null")
    admitted = written(C.admit(sound, heads, current.select("entity_id", "page_hash", "page_artifact"), tasks, artifact), "admitted")
    queue = dealt(admitted.where("admission in ('inserted', 'queued', 'queued_epoch')")).join(dealt(sources.select("entity_id", "snapshot", "source_hash")), "entity_id")
    queue = written(queue.select(F.lit("run").alias("domain"), F.col("entity_id").alias("task_id"), F.lit("pending").alias("status"), F.lit(now).alias("next_attempt_at"), F.lit(0).alias("retry_count"), (F.octet_length("snapshot") + 256).alias("cost")), "queue")
    claimed = written(C.claim(queue, now, 1 << 30, budget).select(F.col("task_id").alias("entity_id"), "lease_until"), "claimed")
    work = written(dealt(once).join(dealt(claimed), "entity_id", "left_semi"), "work")
    evidence = written(compiler(work, knowledge), "evidence")  # a compiler may be costly or not repeatable
    refs, assertions = explode_evidence(evidence, work)
    units = C.coverable_units(work, knowledge)
    ids = work.select(F.col("entity_id").alias("page_id"), "entity_id", "source_revision")
    checked = written(C.check_refs(refs, units, ids), "checked")
    report = C.ref_report(checked, C.check_assertions(assertions, checked))
    scored = written(C.gate(C.scores(report, units.select(F.col("entity_id").alias("page_id")).repartition(tasks_for(once.sparkSession, checked.count(), joined=True), "page_id").groupBy("page_id").agg(F.count("*").alias("units")))), "scored")
    accepted = scored.where("accepted").select(F.col("page_id").alias("entity_id"))
    compiled = evidence.join(accepted, "entity_id", "left_semi").join(sources.select("entity_id", "source_hash"), "entity_id").select("entity_id", F.lit("run").alias("token"), "source_hash", F.col("markdown").alias("content"))
    fenced = claimed.select("entity_id", F.lit("running").alias("status"), F.lit("run").alias("token"), "lease_until")
    new_heads = sources.select("entity_id", F.col("source_hash").alias("head_hash"))
    pages = C.publish(current, compiled, fenced, new_heads, now)
    outcomes = (
        sources.where("preflight is not null")
        .select(F.lit("quarantined").alias("outcome"))
        .unionByName(scored.select(F.when(F.col("accepted"), "accepted").otherwise("failed").alias("outcome")))
        .unionByName(admitted.where("admission in ('skipped', 'rejected')").select(F.col("admission").alias("outcome")))
        .unionByName(dealt(queue.select(F.col("task_id").alias("entity_id"))).join(dealt(claimed), "entity_id", "left_anti").select(F.lit("queued").alias("outcome")))
    )
    return Run(pages, scored, admitted, C.run_stats(outcomes))
