"""Lexical retrieval: phrase match, BM25 over the whole accepted index, short terms.

All terms of a request share one scan of the texts: statistics (over every accepted
page, before any scope) are observed while the hits' frequencies are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import occurrences
from ..sources.shared import written

K1, B, LEAST_IDF, GRAM = 1.2, 0.75, 1e-6, 3


def term_frequency(term: str) -> Column:
    """Occurrences in title and content; a null text has none."""
    return F.coalesce(occurrences(F.col("title"), term), F.lit(0)) + F.coalesce(occurrences(F.col("content"), term), F.lit(0))


def document_length() -> Column:
    part = lambda c: F.greatest(F.length(c) - (GRAM - 1), F.lit(0))
    return part("title") + part("content")


def bm25(frequency: Column, length: Column, df: int, stats: dict) -> Column:
    """Score of one phrase that df rows have."""
    return score_of(frequency, length, F.lit(df), stats)


def score_of(frequency: Column, length: Column, df: Column, stats: dict) -> Column:
    """Score of a phrase in an index of n rows of average length avgdl; the inverse frequency is never below 1e-6."""
    n = F.lit(float(stats["n"]))
    idf = F.log((n - df + 0.5) / (df + 0.5))
    f = frequency.cast("double")
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(float(stats["avgdl"] or 1.0))))


def contains_term(term: str) -> Column:
    low = F.lit(term.lower())
    return F.contains(F.lower("title"), low) | F.contains(F.lower("content"), low)


def lexical_hits(pages: DataFrame, terms: list[str], scope: Column | None = None, within: DataFrame | None = None) -> DataFrame:
    """page_id, term, score of every accepted page in scope (a predicate, and the page_ids of `within`); terms under three characters match anywhere and score 1.

    The texts are read once: the index's statistics are taken of all pages while the hits' frequencies are written.
    """
    accepted = pages.where("status = 'accepted'")
    terms = list(dict.fromkeys(terms or [""]))
    long = [t for t in terms if len(t) >= GRAM]
    short = [t for t in terms if len(t) < GRAM]
    seen = accepted.withColumn("q_in", F.lit(True) if scope is None else F.coalesce(scope, F.lit(False)))
    seen = seen.select("page_id", "q_in", document_length().alias("q_dl"), *[term_frequency(t).alias(f"q_f{i}") for i, t in enumerate(long)], *[contains_term(t).alias(f"q_s{i}") for i, t in enumerate(short)])
    told = Observation()
    seen = seen.observe(told, F.count(F.lit(1)).alias("n"), F.avg("q_dl").alias("avgdl"), *[F.count(F.when(F.col(f"q_f{i}") > 0, 1)).alias(f"df{i}") for i in range(len(long))])
    hit = reduce(Column.__or__, [F.col(f"q_f{i}") > 0 for i in range(len(long))] + [F.col(f"q_s{i}") for i in range(len(short))])
    hits = written(seen.where(F.col("q_in") & hit).drop("q_in"), "hits")
    stats = {k: v or 0 for k, v in told.get.items()}
    if within is not None:
        hits = hits.join(within.select("page_id").distinct(), "page_id", "left_semi")
    each = [F.struct(F.lit(t).alias("term"), F.when(F.col(f"q_f{i}") > 0, bm25(F.col(f"q_f{i}"), F.col("q_dl"), stats[f"df{i}"], stats)).alias("score")) for i, t in enumerate(long)]
    each += [F.struct(F.lit(t).alias("term"), F.when(F.col(f"q_s{i}"), F.lit(1.0)).alias("score")) for i, t in enumerate(short)]
    return hits.select("page_id", F.explode(F.filter(F.array(*each), lambda x: x["score"].isNotNull())).alias("h")).select("page_id", "h.term", "h.score")


def lexical_topk(pages: DataFrame, terms: list[str], k: int, scope: Column | None = None, combine: str = "max", within: DataFrame | None = None, index=None) -> DataFrame:
    """Best k pages by their best term (max) or by all terms together (sum); ties to the smaller page.

    With a trigram index of these pages, terms of three or more characters are looked up there and no text is read for them.
    """
    best = {"max": F.max, "sum": F.sum}[combine]("score")
    long = [t for t in terms if len(t) >= GRAM] if index is not None else []
    short = [t for t in terms if t not in long]
    hits = index.hits(long, scope, within) if long else None
    if short or hits is None:
        scanned = lexical_hits(pages, short, scope, within)
        hits = scanned if hits is None else hits.unionByName(scanned)
    hits = hits.groupBy("page_id").agg(F.round(best, 9).alias("score"))
    return hits.orderBy(F.desc("score"), "page_id").limit(k)


def related_terms(title: str, aliases: list[str], budget: int = 256) -> list[str]:
    """Distinct terms of three or more characters that fit the budget, quotes and separators included."""
    out, used = [], 0
    for t in dict.fromkeys(x.strip() for x in [title, *aliases]):
        cost = len(t) + 2 + (4 if out else 0)
        if len(t) >= GRAM and used + cost <= budget:
            out.append(t)
            used += cost
    return out


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text, from three shifted lists of its characters (a substring per place would walk the text each time)."""
    chars = F.split(F.coalesce(text, F.lit("")), "")
    pairs = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.filter(F.zip_with(pairs, F.slice(chars, 3, 1 << 30), lambda x, y: F.concat(x, y)), lambda g: F.length(g) == GRAM))


def batch_topk(pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, page_id, score: one phrase per query, any number of queries, all of them in one plan.

    queries: query_id, term (three or more characters that don't overlap themselves). Pages and phrases
    meet by equality on each phrase's rarest trigram and are then compared; no phrase is compared with every page.
    """
    accepted = pages.where("status = 'accepted'").select("page_id", document_length().alias("dl"), F.lower("title").alias("t"), F.lower("content").alias("c"))
    stats = accepted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    q = written(queries.select("query_id", F.lower("term").alias("term")).where(F.length("term") >= GRAM), "phrases")
    asked = q.select("query_id", "term", F.explode(_grams(F.col("term"))).alias("gram"))
    own = F.array_distinct(F.concat(_grams(F.coalesce("t", F.lit(""))), _grams(F.coalesce("c", F.lit("")))))
    postings = accepted.select("page_id", F.explode(own).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    postings = written(postings, "postings")
    common = postings.groupBy("gram").agg(F.count("*").alias("pages"))
    rarest = asked.join(common, "gram").groupBy("query_id", "term").agg(F.min(F.struct("pages", "gram")).alias("r")).select("query_id", "term", F.col("r.gram").alias("gram"))
    pairs = postings.join(rarest, "gram").select("query_id", "term", "page_id")
    tf = lambda c: F.coalesce((F.length(c) - F.length(F.replace(F.col(c), F.col("term"), F.lit("")))) / F.length("term"), F.lit(0.0))
    hits = written(pairs.join(accepted, "page_id").select("query_id", "page_id", "dl", (tf("t") + tf("c")).alias("f")).where("f > 0"), "hits")
    df = hits.groupBy("query_id").agg(F.count("*").alias("df"))
    score = score_of(F.col("f"), F.col("dl"), F.col("df"), stats.asDict())
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    return hits.join(df, "query_id").select("query_id", "page_id", F.round(score, 9).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "page_id", "score")
