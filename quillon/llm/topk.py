"""Exact top-k inner-product search by Fagin's threshold algorithm.

A block of candidate vectors holds one sorted list per dimension. For a query,
the lists are read in step from the end that its component's sign prefers; each
newly seen vector is scored in full by random access; reading stops when the
threshold - the best score that an unseen vector could still have - cannot beat
the k-th best result. The k best of each block are merged per query.

Queries travel in blocks of about `block_queries` rows, each against all
candidates, one block at a time: the driver and the executors hold one, and each
block's results are written before the next goes out. Candidates are never shuffled.
A task carries its k best of each query from one candidate block to the next,
where they are the first bound, and sends on k rows per query in all. Scores are exact: integers throughout (float64 BLAS only where every
sum stays below 2**53).

Edge cases: null vectors and those with a null or non-finite component take no
part; vectors of another length than the query's are no candidates; ties go to
the smaller id; fewer than k candidates give fewer rows; repeated ids are rows of their own,
and a row is left out of its query's results by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_arrow, materialize, scratch, table

EXACT = float(1 << 53)


class SortedLists:
    """One block of candidates: a sorted list of rows per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.lists, 0)
        self.most = float(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(np.float64)
        self.scored = 0  #: random accesses so far

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(query).max(initial=0)) * len(query) < EXACT:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ query

    def top(self, query_id: int, query: np.ndarray, k: int, known: tuple[np.ndarray, np.ndarray] | None = None, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), best first, of this block and what is known from others; step doubles as the lists are read, so the bound is tested a logarithmic number of times."""
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        seen = np.zeros(n, bool)
        best_id, best = known or (np.empty(0, np.int64), np.empty(0, np.int64))
        depth = 0
        while depth < n:
            if len(best) == k and self.threshold(query, used, depth) < int(best[-1]):  # an equal score could still win a tie
                break
            to = min(n, depth + step)
            if len(used):
                down = query[used] > 0
                near = np.concatenate([self.lists[n - to : n - depth, used[down]].ravel(), self.lists[depth:to, used[~down]].ravel()])
                new = np.zeros(n, bool)
                new[near] = True
                rows = np.flatnonzero(new & ~seen)
                seen |= new
            else:
                rows, to = np.arange(n), n  # the zero query: all scores are equal
            depth, step = to, step * 2
            rows = rows[self.ids[rows] != query_id]
            self.scored += len(rows)
            best_id, best = np.append(best_id, self.ids[rows]), np.append(best, self.scores(rows, query))
            keep = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[keep], best[keep]
        return best_id, best

    def threshold(self, query: np.ndarray, used: np.ndarray, depth: int) -> int:
        """The best score that a vector may have that no list has shown down to `depth`."""
        at = np.where(query[used] > 0, self.sorted[len(self.sorted) - 1 - depth, used], self.sorted[depth, used])
        return sum(int(a) * int(b) for a, b in zip(at, query[used], strict=True))


def usable(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    x = F.col(vector_column)
    fit = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.col(id_column).isNotNull()
    return vectors.where(fit).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_queries: int = 16384, block_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) from integer vectors (id, v); queries: rows (id, v)."""
    spark = vectors.sparkSession
    asked = materialize(queries.select("id", "v"), "queries")
    blocks = max(1, -(-asked.count() // block_queries))
    number = F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long"))
    out = scratch(spark, "nearest")
    for block in range(blocks):
        rows = asked.where(number == block).collect()
        shared = spark.sparkContext.broadcast(([r.id for r in rows], [np.array(r.v, np.int64) for r in rows]))
        del rows
        _search(vectors, shared, k, block_rows).write.parquet(f"{out}/block={block}")
        shared.destroy()
    near = spark.read.schema("query_id long, vec_id long, score long").parquet(*[f"{out}/block={block}" for block in range(blocks)])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, shared, k: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score): the k best candidates that a task has for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)

        def flush(held: list[pa.RecordBatch]) -> None:
            own = np.concatenate([x.column("id").to_numpy(zero_copy_only=False) for x in held])
            sizes = np.concatenate([pa.compute.list_value_length(x.column("v")).to_numpy(zero_copy_only=False) for x in held])
            flat = np.concatenate([x.column("v").flatten().to_numpy(zero_copy_only=False) for x in held])
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                lists = SortedLists(own[mine], flat[(ends[mine] - size)[:, None] + np.arange(size)])
                for i, query in enumerate(queries):
                    if len(query) == size:
                        best[i] = lists.top(ids[i], query, k, best[i])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block_rows:
                flush(held)
                held, rows = [], 0
        if rows:
            flush(held)
        found = [i for i, x in enumerate(best) if x is not None and len(x[0])]
        if found:
            q = np.repeat([ids[i] for i in found], [len(best[i][0]) for i in found])
            columns = [q, *(np.concatenate([best[i][part] for i in found]) for part in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["query_id", "vec_id", "score"])

    return in_arrow(vectors, run, "query_id long, vec_id long, score long")


def op9(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return top_k(vectors, vectors.where("id % 100 = 0"), 10)


OP9_SQL = """
with ok as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) score
  from ok q join ok c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from pairs)
select query_id, cast(r as integer) "rank", vec_id, score from ranked where r <= 10
"""
