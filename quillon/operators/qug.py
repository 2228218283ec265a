"""The query-understanding graph: edges, builds, rewriting, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import framed_hash, normalize
from ..sources.shared import written

PHRASES, TERMS, DEPTH = 16, 64, 4
BROADCAST_ROWS = 50_000


def page_edges(pages: DataFrame) -> DataFrame:
    """src, dst, kind, page_id: alias -> title (synonym), title -> tag (hyponym). pages: page_id, title, aliases, tags."""
    title = normalize(F.col("title"))
    named = pages.where(title.isNotNull())
    each = lambda names: named.select("page_id", title.alias("title"), F.explode(names).alias("name")).withColumn("name", normalize(F.col("name")))
    synonyms = each("aliases").select(F.col("name").alias("src"), F.col("title").alias("dst"), F.lit("synonym").alias("kind"), "page_id").where("src is not null and src <> dst")
    hyponyms = each("tags").select(F.col("title").alias("src"), F.col("name").alias("dst"), F.lit("hyponym").alias("kind"), "page_id").where("dst is not null")
    return synonyms.unionByName(hyponyms)


def build(edges: DataFrame) -> DataFrame:
    """Distinct edges with their hash; of equal ones that of the smallest page stays."""
    hashed = edges.withColumn("edge_hash", framed_hash("edge", F.col("src"), F.col("dst"), F.col("kind")))
    return hashed.groupBy("edge_hash", "src", "dst", "kind").agg(F.min("page_id").alias("page_id"))


def source_hash(edges: DataFrame) -> DataFrame:
    """One row: a hash of the sorted edge hashes and their number. The fold is over per-bucket digests, so no task holds all hashes."""
    buckets = edges.select("edge_hash", F.substring("edge_hash", 1, 3).alias("b")).groupBy("b").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("edge_hash"))), 256).alias("h"), F.count("*").alias("n"))
    return buckets.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat("b", F.lit(":"), "h")))), 256).alias("source_hash"), F.sum("n").alias("n_edges"))


def longest_matches(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, start, phrase: at each start position of the normalized query, its longest graph phrase; the 16 longest.

    Substrings of a query that have a phrase's length are few, so they are
    exploded and joined by equality, not compared with every phrase.
    Spark's estimate doesn't see the explosion and would broadcast the substrings;
    so the phrases are, up to BROADCAST_ROWS of them, and else both are shuffled.
    """
    phrases = edges.select(F.col("src").alias("phrase")).unionByName(edges.select(F.col("dst").alias("phrase"))).distinct()
    phrases = written(phrases, "phrases")
    sizes = {r.size: r.n for r in phrases.groupBy(F.length("phrase").alias("size")).agg(F.count("*").alias("n")).collect()}  # phrases have 128 characters at most
    lengths = F.array(*map(F.lit, sorted(sizes))).cast("array<int>")
    phrases = F.broadcast(phrases) if sum(sizes.values()) <= BROADCAST_ROWS else phrases.hint("merge")
    q = queries.select("query_id", normalize(F.col("query_text")).alias("q")).where("q is not null")
    starts = q.select("query_id", "q", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("start"))
    spans = starts.select("query_id", "start", "q", F.explode(F.filter(lengths, lambda n: n <= F.length("q") - F.col("start") + 1)).alias("n"))
    found = spans.select("query_id", "start", F.substring(F.col("q"), F.col("start"), F.col("n")).alias("phrase")).join(phrases, "phrase")
    per_start = found.groupBy("query_id", "start").agg(F.max_by("phrase", F.length("phrase")).alias("phrase"))
    w = W.partitionBy("query_id").orderBy(F.desc(F.length("phrase")), "phrase", "start")
    return per_start.withColumn("place", F.row_number().over(w)).where(F.col("place") <= PHRASES)


def rewrite(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, terms (the normalized query, then its one-hop expansions, 64 at most), status applied or fallback."""
    q = queries.select("query_id", normalize(F.col("query_text")).alias("q"))
    hops = longest_matches(queries, edges).join(edges.where("kind in ('synonym', 'hyponym')"), F.col("phrase") == F.col("src")).groupBy("query_id", "dst").agg(F.min(F.struct("place", "kind", "edge_hash")).alias("o"))
    terms = hops.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", "dst"))).alias("x")).select("query_id", F.transform("x", lambda e: e["dst"]).alias("more"))
    out = q.join(terms, "query_id", "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    all_ = F.slice(F.array_distinct(F.concat(F.array("q"), F.col("more"))), 1, TERMS)
    return out.select("query_id", all_.alias("terms"), F.when(F.size(all_) > 1, "applied").otherwise("fallback").alias("status"))


def paths(edges: DataFrame, start: DataFrame, depth: int = DEPTH) -> DataFrame:
    """nodes: every simple path (as an array) of 1 to `depth` edges from the start phrases."""
    step = edges.select("src", "dst").distinct()
    now = start.select(F.array("phrase").alias("nodes"))
    out = None
    for _ in range(min(depth, DEPTH)):
        now = now.join(step, F.element_at("nodes", -1) == F.col("src")).where(~F.array_contains("nodes", F.col("dst"))).select(F.concat("nodes", F.array("dst")).alias("nodes"))
        out = now if out is None else out.unionByName(now)
    return out


def snapshot_problems(pages: DataFrame, edges: DataFrame, most: int | None = 100_000) -> DataFrame:
    """problem, n of a graph's source: empty ids, generations under 1, repeated pages, too many rows (unless most is None)."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    parts = [
        count(pages.where("page_id is null or trim(cast(page_id as string)) = ''"), "empty_id"),
        count(pages.where("generation < 1 or generation is null"), "generation"),
        count(pages.groupBy("page_id").agg(F.count("*").alias("c")).where("c > 1"), "repeated_page"),
    ]
    if most is not None:
        parts += [df.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(name).alias("problem"), "n") for df, name in ((pages, "too_many_pages"), (edges, "too_many_edges"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def rewrite_with_intents(query: str, edges: DataFrame, intents: list, conditions: list) -> dict:
    """One query's terms, merged conditions and status; intents whose phrase is among its longest matches add their text and conditions."""
    from .filters import merge

    spark = edges.sparkSession
    loops = [(p, i) for i in intents for p in i.phrases]
    phrases = spark.createDataFrame([(p, p, "intent", i.id) for p, i in loops], "src string, dst string, kind string, edge_hash string")
    phrases = phrases.select(normalize(F.col("src")).alias("src"), normalize(F.col("dst")).alias("dst"), "kind", "edge_hash").where("src is not null")
    graph = edges.select("src", "dst", "kind", "edge_hash").unionByName(phrases)
    one = spark.createDataFrame([(0, query)], "query_id long, query_text string")
    matched = {r.phrase for r in longest_matches(one, graph).collect()}
    row = rewrite(one, graph).first()
    low = lambda x: " ".join(x.split()).lower()
    hit = list({i.id: i for p, i in loops if low(p) in matched}.values())
    terms = list(dict.fromkeys([*row.terms, *(low(i.text) for i in hit if i.text)]))[:TERMS]
    merged = merge([*conditions, *(c for i in hit for c in i.conditions)])
    return {"terms": terms, "conditions": merged, "status": "applied" if hit or len(terms) > 1 else "fallback"}
