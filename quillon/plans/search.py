"""Search: rewrite, push filters down, relax once, recall twice, fuse."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Condition, anchor_scope, merge, relax
from ..operators.fusion import candidate_depth, rrf
from ..operators.lexical import lexical_topk
from ..operators.qug import rewrite_with_intents
from ..operators.vectors import vector_topk
from ..sources.shared import written

TEXT_CHARS, MOST_K = 4096, 100


@dataclass
class Query:
    text: str
    conditions: list[Condition] = field(default_factory=list)
    top_k: int = 10
    domain: str | None = None

    def check(self) -> None:
        if len(self.text) > TEXT_CHARS or not 1 <= self.top_k <= MOST_K:
            raise ValueError("query out of bounds")


def scope_or_relaxed(facts: DataFrame, refs: DataFrame, conditions: list[Condition], anchor: str = "category") -> tuple[DataFrame, list[Condition], bool]:
    """The anchors in scope; if there are none, those of the conditions relaxed once."""
    scope = anchor_scope(facts, refs, conditions, anchor)
    if conditions and scope.isEmpty() and (less := relax(conditions)) is not None:
        return anchor_scope(facts, refs, less, anchor), less, True
    return scope, conditions, False


def search(
    pages: DataFrame,
    query: Query,
    terms: list[str] | None = None,
    vectors: DataFrame | None = None,
    query_vector: list[float] | None = None,
    scope: Column | None = None,
    multiplier: int = 5,
    facts: DataFrame | None = None,
    refs: DataFrame | None = None,
    index=None,
) -> DataFrame:
    """page_id, score: fused lexical and vector recall (lexical alone without vectors); index: a trigram index of the pages.

    vectors: id (the page), vec, entity_id. A query with conditions needs facts and refs.
    """
    return answer(pages, query, terms, vectors, query_vector, scope, multiplier, facts, refs, index=index).hits


@dataclass
class Answer:
    """What a search found, and what its log row tells."""

    hits: DataFrame
    terms: list[str]
    conditions: list[Condition]
    empty_at_first: bool = False
    relaxed: bool = False
    rewrite: str = "disabled"

    def log_row(self, query: Query) -> DataFrame:
        """query_text, domain, top_k, hit_count, candidate_empty_initial, relaxation_succeeded, rewrite_status, n_terms, n_conditions: one row, for `sinks.append_log`."""
        found = self.hits.agg(F.count("*").alias("hit_count"))
        given = {"query_text": query.text, "domain": query.domain, "top_k": query.top_k, "candidate_empty_initial": self.empty_at_first, "relaxation_succeeded": self.relaxed, "rewrite_status": self.rewrite, "n_terms": len(self.terms), "n_conditions": len(self.conditions)}
        return found.select("hit_count", *[F.lit(v).alias(k) for k, v in given.items()]).withColumn("domain", F.col("domain").cast("string"))


def answer(
    pages: DataFrame,
    query: Query,
    terms: list[str] | None = None,
    vectors: DataFrame | None = None,
    query_vector: list[float] | None = None,
    scope: Column | None = None,
    multiplier: int = 5,
    facts: DataFrame | None = None,
    refs: DataFrame | None = None,
    edges: DataFrame | None = None,
    intents: list = (),
    anchor: str = "category",
    index=None,
) -> Answer:
    """A whole search: rewrite by the graph, conditions to anchors to pages (relaxed once if none is left), recall within them, fusion, and the scope once more before the cut."""
    query.check()
    conditions, rewritten = merge(query.conditions), "disabled"
    if edges is not None:
        found = rewrite_with_intents(query.text, edges, list(intents), conditions)
        terms, conditions, rewritten = found["terms"], found["conditions"], found["status"]
    depth = candidate_depth(query.top_k, multiplier)
    if query.domain is not None:
        inside = F.col("domain") == query.domain
        scope = inside if scope is None else scope & inside
    within, empty, relaxed = None, False, False
    if conditions:
        if facts is None or refs is None:
            raise ValueError("conditions need facts and refs")
        anchors, left, tried = scope_or_relaxed(facts, refs, conditions, anchor)
        empty, conditions = tried or anchors.isEmpty(), left
        relaxed = tried and not anchors.isEmpty()
        within = written(pages.join(anchors.select(F.col("anchor").alias("entity_id")), "entity_id", "left_semi").select("page_id"), "scope")
    lists = [lexical_topk(pages, terms or [query.text], depth, scope, within=within, index=index)]
    if vectors is not None and query_vector is not None:
        live = pages.where("status = 'accepted'") if scope is None else pages.where("status = 'accepted'").where(scope)
        live = live.select(F.col("page_id").alias("id"))
        if within is not None:
            live = live.join(within.select(F.col("page_id").alias("id")), "id", "left_semi")
        lists.append(vector_topk(vectors.join(live, "id", "left_semi"), query_vector, depth).select(F.col("id").alias("page_id"), "score"))
    fused = rrf(lists, query.top_k if within is None else 2 * depth)
    if within is not None:
        fused = fused.join(within, "page_id", "left_semi").orderBy(F.desc("score"), "page_id").limit(query.top_k)
    return Answer(fused, terms or [query.text], conditions, empty, relaxed, rewritten)
