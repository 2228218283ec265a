"""Blind-spot analysis of query logs and feedback, reviews and event validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize

LEAST_EVENTS, LEAST_SHARE, REPORT_ROWS = 5, 20, 1000
# Review actions and statuses.
ACTIONS = ("supplemental_compile", "query_template", "ignore", "compile_dead_letter", "consistency_conflict", "compatibility_conflict")
STATUSES = ("pending", "approved", "ignored", "failed")


def pending_reviews(reviews: DataFrame) -> DataFrame:
    """domain, action, pending: how many reviews wait; a domain and action without any has no row."""
    return reviews.where("status = 'pending'").groupBy("domain", "action").agg(F.count("*").alias("pending"))


def window(df: DataFrame, column: str, start: str, end: str, domain: str | None = None) -> DataFrame:
    """Rows of a closed window, both ends included."""
    out = df.where(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return out.where(F.col("domain") == domain) if domain else out


def _by_query(logs: DataFrame) -> DataFrame:
    return logs.groupBy(normalize(F.col("query_text")).alias("query")).agg(F.count("*").alias("occurrences"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.sort_array(F.collect_list("log_id")).alias("log_ids"))


def zero_recall(logs: DataFrame) -> DataFrame:
    """Queries without hits, but for those whose filters left nothing and could not be relaxed."""
    return _by_query(logs.where("hit_count = 0 and not (candidate_empty_initial and not relaxation_succeeded)"))


def rewrite_failures(logs: DataFrame) -> DataFrame:
    return _by_query(logs.where("rewrite_failure"))


def low_quality_pages(events: DataFrame) -> DataFrame:
    """Pages of five or more events of which under a fifth adopt (adoption, or a rating of four or more)."""
    adopted = F.coalesce((F.col("kind") == "adopt") | ((F.col("kind") == "rate") & (F.col("rating") >= 4)), F.lit(False))
    per = events.where("page_id is not null").groupBy("page_id").agg(F.count("*").alias("events"), F.sum(adopted.cast("long")).alias("adopted"), F.sort_array(F.collect_set("log_id")).alias("log_ids"))
    return per.where((F.col("events") >= LEAST_EVENTS) & (F.col("adopted") * 100 < F.col("events") * LEAST_SHARE))


def suggestions(logs: DataFrame, events: DataFrame) -> DataFrame:
    """action, subject, occurrences of what the analysis proposes."""
    one = lambda df, action, subject, n: df.select(F.lit(action).alias("action"), subject.alias("subject"), n.alias("occurrences"))
    return (
        one(zero_recall(logs), "supplemental_compile", F.concat(F.lit("query:"), "query"), F.col("occurrences"))
        .unionByName(one(rewrite_failures(logs), "query_template", F.concat(F.lit("query:"), "query"), F.col("occurrences")))
        .unionByName(one(low_quality_pages(events), "supplemental_compile", F.concat(F.lit("page:"), F.col("page_id").cast("string")), F.col("events")))
    )


def reject_reason(log_domain: Column) -> Column:
    """Why an event is refused (null: accepted); log_domain: its log's domain, null if the log is missing."""
    key, kind, page, rating, meta = map(F.col, ("idempotency_key", "kind", "page_id", "rating", "metadata_json"))
    return (
        F.when(~F.coalesce(key.rlike(r"\A[\x21-\x7e]{1,128}\z"), F.lit(False)), "key")
        .when(log_domain.isNull(), "log_missing")
        .when(log_domain != F.col("domain"), "domain")
        .when((kind == "rate") & ~F.coalesce(rating.between(1, 5), F.lit(False)), "rating")
        .when(kind.isin("click", "adopt") & page.isNull(), "page_missing")
        .when(kind.isin("click", "adopt") & rating.isNotNull(), "rating_given")
        .when((F.octet_length(meta) > 4096) | ~F.coalesce(meta.rlike(r"(?s)\A\s*\{.*\}\s*\z"), F.lit(True)), "metadata")
    )


def validated(events: DataFrame, logs: DataFrame) -> DataFrame:
    """Events with their reject_reason."""
    known = logs.select("log_id", F.col("domain").alias("_log_domain"))
    return events.join(known, "log_id", "left").withColumn("reject_reason", reject_reason(F.col("_log_domain"))).drop("_log_domain")


def decide(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews after decisions (review_id, decision approve or ignore): only pending ones change."""
    new = F.when(F.col("status") != "pending", F.col("status")).when(F.col("decision") == "approve", "approved").when(F.col("decision") == "ignore", "ignored").otherwise(F.col("status"))
    return reviews.join(decisions, "review_id", "left").withColumn("status", new).drop("decision")


def approve(reviews: DataFrame, tasks: DataFrame, heads: DataFrame, admissions: DataFrame) -> DataFrame:
    """review_id, status, compile_task_id, problem (why a review stays as it is) after every review is approved once.

    Only pending reviews change. A query template or a compatibility conflict is
    approved as such. A supplemental compile needs an admission that queues a task of its
    own domain. A dead letter needs a dead task of its domain whose source is still its
    head's and which is queued anew; a consistency conflict the same, dead or not, and it
    becomes a supplemental compile besides (`conversions`).

    reviews: review_id, domain, action, status, entity_id, task_id. tasks: task_id,
    entity_id, task_status, source_hash. heads: entity_id, head_hash. admissions:
    entity_id, admission, queued_task.
    """
    task = tasks.select("task_id", F.col("entity_id").alias("task_entity"), "task_status", "source_hash")
    seen = reviews.join(task, "task_id", "left").withColumn("entity", F.coalesce("task_entity", "entity_id"))
    seen = seen.join(heads.select(F.col("entity_id").alias("entity"), "head_hash"), "entity", "left").join(admissions.select(F.col("entity_id").alias("entity"), "admission", "queued_task"), "entity", "left")
    action, no = F.col("action"), lambda c: ~F.coalesce(c, F.lit(False))
    plain, again = action.isin("query_template", "compatibility_conflict"), action.isin("compile_dead_letter", "consistency_conflict")
    queued = F.col("admission").isin("inserted", "queued", "queued_epoch")
    problem = (
        F.when(F.col("status") != "pending", "not_pending")
        .when(~action.isin(*ACTIONS) | (action == "ignore"), "action")
        .when(plain, None)
        .when(again & F.col("task_status").isNull(), "task_missing")
        .when((action == "compile_dead_letter") & no(F.col("task_status") == "dead"), "not_dead")
        .when(no(F.split("entity", ":", 2)[0] == F.col("domain")), "domain")
        .when(again & no(F.col("head_hash") == F.col("source_hash")), "head_moved")
        .when(no(queued) | again & no(F.col("queued_task") == F.col("task_id")), "not_queued")
    )
    seen = seen.withColumn("problem", problem)
    fine = F.col("problem").isNull()
    return seen.select("review_id", F.when(fine, "approved").otherwise(F.col("status")).alias("status"), F.when(fine & ~plain, F.col("queued_task")).alias("compile_task_id"), "problem")


def conversions(reviews: DataFrame, approved: DataFrame, tasks: DataFrame) -> DataFrame:
    """domain, action, entity_id, status, compile_task_id: the supplemental compiles that approved consistency conflicts become, one per domain and entity, unless the queue has it."""
    done = approved.where("status = 'approved' and problem is null").select("review_id", "compile_task_id")
    new = reviews.where("action = 'consistency_conflict'").drop("entity_id").join(done, "review_id").join(tasks.select("task_id", "entity_id"), "task_id")
    new = new.groupBy("domain", "entity_id").agg(F.min("compile_task_id").alias("compile_task_id"))
    there = reviews.where("action = 'supplemental_compile'").select("domain", "entity_id").distinct()
    return new.join(there, ["domain", "entity_id"], "left_anti").select("domain", F.lit("supplemental_compile").alias("action"), "entity_id", F.lit("approved").alias("status"), "compile_task_id")
