"""A published trigram index: every place of every trigram in the titles and contents of the accepted pages.

A generation is a folder of three tables. `places` (gram, page_id, at) has one row per place, case-folded, titles from 0 and
contents from 2^30, so that no phrase spans both. Pages are dealt to files by their number, some four million places a file, before
their places are made: these are sorted by gram in memory and never shuffled or spilled. The filter on a gram finds its run in each
file by the column index, and a frequent gram's run is spread over all files. `grams` (gram, n_places) tells how frequent each
is. `docs` has the pages without their texts, and their lengths (dl). The pointer names a generation only once it is whole.

page_id is the pages' key. Null texts are empty; an empty table gives an empty index.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lexical import GRAM, bm25, document_length, score_of
from .shared import tasks_for, written
from .sinks import PublishedTable

CONTENT_AT = 1 << 30
#: Texts are cut into pieces of so many characters, with the overlap that trigrams need, so that a row's lists stay small.
PIECE = 1 << 16
GROUP_BYTES = 16 << 20
#: Characters whose places one task of a build sorts, about: some 300 MB of its memory.
CHARS_EACH = 1 << 22


def cover(term: str) -> list[int]:
    """Offsets of trigrams that together hold every character of a term."""
    return sorted({*range(0, len(term) - GRAM + 1, GRAM), len(term) - GRAM})


def places_of(pages: DataFrame, piece: int = PIECE) -> DataFrame:
    """page_id, gram, at of every trigram."""
    part = lambda c, base: F.struct(F.lit(base).alias("base"), F.lower(F.coalesce(F.col(c), F.lit(""))).alias("text"))
    texts = pages.select("page_id", F.explode(F.array(part("title", 0), part("content", CONTENT_AT))).alias("p")).select("page_id", "p.*")
    pieces = texts.select("page_id", "base", "text", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(piece))).alias("from"))
    pieces = pieces.select("page_id", (F.col("base") + F.col("from")).alias("base"), F.substring(F.col("text"), F.col("from") + 1, F.lit(piece + GRAM - 1)).alias("text"))
    chars = F.split("text", "")
    pairs = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda x, y: F.concat(x, y))
    grams = F.zip_with(pairs, F.slice(chars, 3, 1 << 30), lambda x, y: F.concat(x, y))
    found = pieces.select("page_id", "base", F.posexplode(grams).alias("at", "gram")).where(F.length("gram") == GRAM)
    return found.select("gram", "page_id", (F.col("base") + F.col("at")).cast("int").alias("at"))


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointer = PublishedTable(spark, f"{self.path}/index")

    def build(self, pages: DataFrame) -> TrigramIndex:
        """Index the accepted pages and publish the generation."""
        accepted = pages.where("status = 'accepted'")
        folder = f"{self.path}/generation-{uuid.uuid4().hex}"
        accepted.withColumn("dl", document_length()).drop("title", "content").write.parquet(f"{folder}/docs")
        told = self.spark.read.parquet(f"{folder}/docs").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("chars")).first()
        n = tasks_for(self.spark, told.chars, CHARS_EACH)
        dealt = accepted.select("page_id", "title", "content").repartition(n, "page_id")
        placed = places_of(dealt).sortWithinPartitions("gram", "page_id", "at")
        placed.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/places")
        grams = self.spark.read.parquet(f"{folder}/places").groupBy("gram").agg(F.count("*").alias("n_places"))
        grams.write.parquet(f"{folder}/grams")
        row = self.spark.createDataFrame([(told.n, told.avgdl, folder)], "n long, avgdl double, folder string")
        self.pointer.publish(row, force=True)
        self.__dict__.pop("live", None)
        return self

    @cached_property
    def live(self) -> dict:
        """folder, n and avgdl of the generation that was current when first asked."""
        found = self.pointer.current()
        if found is None:
            raise RuntimeError(f"no index is published in {self.path}")
        return found[1].first().asDict()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.live['folder']}/{name}")

    def frequencies(self, terms: list[str]) -> DataFrame:
        """page_id, term, f: overlapping, case-folded occurrences of each term (three characters or more) in each page that has it."""
        wanted = [(t, low[k : k + GRAM], k, len(cover(low))) for t in dict.fromkeys(terms) for low in [t.lower()] for k in cover(low)]
        asked = self.spark.createDataFrame(wanted, "term string, gram string, off int, n int")
        places = self.table("places").where(F.col("gram").isin(sorted({w[1] for w in wanted})))
        met = places.join(F.broadcast(asked), "gram").select("page_id", "term", "n", (F.col("at") - F.col("off")).alias("start"))
        known = self.table("grams").join(F.broadcast(asked), "gram").agg(F.coalesce(F.sum("n_places"), F.lit(0))).first()[0]
        met = met.repartition(tasks_for(self.spark, known), "page_id")
        starts = met.groupBy("page_id", "term", "n", "start").agg(F.count("*").alias("met")).where("met = n")
        return starts.groupBy("page_id", "term").agg(F.count("*").alias("f"))

    def hits(self, terms: list[str], scope: Column | None = None, within: DataFrame | None = None) -> DataFrame:
        """page_id, term, score, as `lexical.lexical_hits` finds them; no text is read. At least one term."""
        terms, told = list(dict.fromkeys(terms)), Observation()
        counts = [F.count(F.when(F.col("term") == t, 1)).alias(f"df{k}") for k, t in enumerate(terms)]
        found = written(self.frequencies(terms).observe(told, *counts), "frequencies")
        df = {t: told.get[f"df{k}"] for k, t in enumerate(terms)}
        docs = self.table("docs")
        seen = found.join((docs if scope is None else docs.where(scope)).select("page_id", "dl"), "page_id")
        if within is not None:
            seen = seen.join(within.select("page_id").distinct(), "page_id", "left_semi")
        score = F.coalesce(*[F.when(F.col("term") == t, bm25(F.col("f"), F.col("dl"), n, self.live)) for t, n in df.items()])
        return seen.select("page_id", "term", score.alias("score"))

    def batch(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, page_id, score of one phrase per query (query_id, term of three or more characters), any number of queries.

        Each query meets the places of its rarest trigram alone; what is found there is then looked up under its other trigrams.
        """
        places, grams = self.table("places"), self.table("grams")
        low = queries.select("query_id", F.lower("term").alias("term")).where(F.length("term") >= GRAM)
        last = F.length("term") - GRAM
        offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last)))
        asked = low.select("query_id", F.size(offsets).alias("n"), F.explode(offsets).alias("off"), "term").select("query_id", "n", "off", F.expr(f"substring(term, off + 1, {GRAM})").alias("gram"))
        counted = asked.join(grams, "gram", "left").groupBy("query_id", "n").agg(F.min(F.struct("n_places", "off", "gram")).alias("least"), F.count("n_places").alias("known")).where("known = n")
        first = written(counted.select("query_id", "n", "least.off", "least.gram"), "rarest")
        starts = places.join(first, "gram").select("query_id", "n", "page_id", (F.col("at") - F.col("off")).alias("start"))
        rest = asked.drop("n").join(first.select("query_id", F.col("off").alias("done")), "query_id").where("off <> done").select("query_id", "off", "gram")
        sought = starts.where("n > 1").join(rest, "query_id").withColumn("at", F.col("start") + F.col("off"))
        others = written(rest.select("gram").distinct().join(grams, "gram"), "others")  # only these trigrams' places are dealt out
        keys, n = ["gram", "page_id", "at"], tasks_for(self.spark, others.agg(F.coalesce(F.sum("n_places"), F.lit(0))).first()[0], joined=True)
        there = places.join(others.select("gram"), "gram", "left_semi").repartition(n, *keys)
        met = sought.repartition(n, *keys).join(there, keys, "left_semi").groupBy("query_id", "n", "page_id", "start").agg(F.count("*").alias("met")).where("met = n - 1")
        whole = starts.where("n = 1").select("query_id", "page_id").unionAll(met.select("query_id", "page_id"))
        found = written(whole.groupBy("query_id", "page_id").agg(F.count("*").alias("f")), "frequencies")
        df = found.groupBy("query_id").agg(F.count("*").alias("df"))
        score = score_of(F.col("f"), F.col("dl"), F.col("df"), self.live)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
        scored = found.join(df, "query_id").join(self.table("docs").select("page_id", "dl"), "page_id").select("query_id", "page_id", F.round(score, 9).alias("score"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "page_id", "score")
