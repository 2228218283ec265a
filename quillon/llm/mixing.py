"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get targets (shares of all words, capped at `most` times their size,
the excess shared again by weight). Each source is laid out as shards, each
shard as one seeded sequence of documents cut into blocks of equal word counts.
The highest quotients target / (2 q + 1) hand out blocks to sources, then to
each source's shards; within a shard, a seeded systematic choice takes every
block `quota div blocks` times and `quota mod blocks` of them once more.

Scale: each text is read once, for its size; (place, source, size) is written and
all else works on that. The driver holds a few numbers a source; a source's shards,
`max_shards` at most, are apportioned in one task a source. A hot source is spread
over its shards. A mix of whole documents shuffles the texts once.

Edge cases: null or wordless texts have size 0 and are never taken; a null
source comes after all others in the order of weights; repeated ids are rows of
their own; an empty table gives no rows; all runs agree, as every order is by
seeded hashes with the row's own values, text included, as ties.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, materialize, placed, table, without

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
ADDED = ["q_size", "q_source_size", "q_target", "q_taken", "q_copies"]


def sainte_lague(weights: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients weight / (2 q + 1), ties to the earlier; none gets more than `most`."""
    exact = [Fraction(w) for w in weights]
    most = most or [seats] * len(exact)
    seats = min(seats, sum(m for w, m in zip(exact, most, strict=True) if w > 0))
    if seats <= 0:
        return [0] * len(exact)

    def held(x: float) -> list[int]:  # seats with a quotient of x or more
        x = Fraction(x)
        return [min(m, int((w / x + 1) // 2)) for w, m in zip(exact, most, strict=True)]

    low, high = 0.0, float(max(exact)) * 2  # held(high) is 0
    for _ in range(80):  # the largest threshold known to give too many or just enough
        mid = (low + high) / 2
        if mid <= 0 or sum(held(mid)) > seats:
            low = mid
        else:
            high = mid
    got = held(high)
    queue = [(-w / (2 * q + 1), i) for i, (w, q, m) in enumerate(zip(exact, got, most, strict=True)) if w > 0 and q < m]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-exact[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds most * size is shared again by weight until none is above."""
    total, out = sum(sizes), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    rest = float(total)
    while open_:
        each = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * each > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * each
            break
        for i in full:
            out[i] = float(most * sizes[i])
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def code_points(name: str | None) -> tuple:
    return (name is None, name or "")  # Python compares strings by code point


def allot(documents: DataFrame, weights=WEIGHTS, most: int = 3, block_words: int = 64, shard_words: int = 1 << 20, max_shards: int = 4096, seed: int = 17) -> DataFrame:
    """q_file, q_row (the row's place), doc_id, source, q_size, q_source_size, q_target, q_taken (words) and q_copies (how often the block of its middle word is taken) of every row.

    weights: repeat over the sources in code-point order.
    """
    spark = documents.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    numbered = placed(documents.select("doc_id", "source", "text"))
    sized = materialize(numbered.select("q_file", "q_row", "doc_id", "source", size.alias("q_size"), F.xxhash64(F.lit(seed), "text").alias("q_hash")), "sizes")
    per = sized.groupBy("source").agg(F.sum("q_size").alias("n")).collect()
    per.sort(key=lambda r: code_points(r.source))
    sizes = [r.n for r in per]
    aims = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(per))], most)
    counts = [max(1, min(max_shards, -(-n // shard_words))) for n in sizes]
    sources = spark.createDataFrame([(r.source, n, t, c) for r, n, t, c in zip(per, sizes, aims, counts, strict=True)], "q_source string, q_source_size long, q_target double, q_shards int")
    few = len(per) < 10_000

    own = F.xxhash64(F.lit(seed), F.col("doc_id"))
    dealt = sized.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("q_source"))).withColumn("q_shard", F.pmod(own, F.col("q_shards").cast("long")).cast("int"))
    shards = materialize(dealt.groupBy("q_source", "q_shard").agg(F.sum("q_size").alias("n")).withColumn("b", F.ceil(F.col("n") / block_words)), "shards")
    held = {r.q_source: r.b for r in shards.groupBy("q_source").agg(F.sum("b").alias("b")).collect()}
    quotas = sainte_lague(aims, round(sum(aims) / block_words), [most * held.get(r.source, 0) for r in per])
    quota = spark.createDataFrame([(r.source, q) for r, q in zip(per, quotas, strict=True)], "of string, quota long")

    def deal(shard: pd.DataFrame) -> pd.DataFrame:
        """A source's quota over its shards, of which there are max_shards at most."""
        shard = shard.sort_values("q_shard")
        n, b = shard["n"].tolist(), shard["b"].astype("int64")
        got = pd.Series(sainte_lague(n, int(shard["quota"].iloc[0]), [most * int(x) for x in b]), index=shard.index, dtype="int64")
        blocks = b.clip(lower=1)
        k = shard["q_shard"].astype("int64")
        return pd.DataFrame({"p_source": shard["q_source"], "p_shard": shard["q_shard"], "q_base": got // blocks, "q_more": got % blocks, "q_blocks": blocks, "q_from": (seed * 7919 + k * 104729) % blocks})

    plan = shards.join(F.broadcast(quota) if few else quota, F.col("q_source").eqNullSafe(F.col("of"))).groupBy("q_source").applyInPandas(deal, "p_source string, p_shard int, q_base long, q_more long, q_blocks long, q_from long")
    plan = materialize(plan, "plan")
    dealt = dealt.join(F.broadcast(plan) if sum(counts) < 100_000 else plan, F.col("q_source").eqNullSafe(F.col("p_source")) & (F.col("q_shard") == F.col("p_shard")))

    order = W.partitionBy("q_source", "q_shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "q_size", "q_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum("q_size").over(order)
    dealt = dealt.withColumn("q_end", end).withColumn("q_start", F.col("q_end") - F.col("q_size"))

    # among blocks 0..j-1, chosen(j) - chosen(0) are taken once more: evenly spread, begun at a seeded place
    chosen = lambda j: F.expr(f"(({j}) + q_from) * q_more div q_blocks")
    once = lambda j: F.col("q_base") + chosen(f"{j} + 1") - chosen(j)
    first, last = f"(q_start div {block_words})", f"((q_end - 1) div {block_words})"
    inner = F.expr(f"q_base * ({last} - {first} - 1)") + chosen(last) - chosen(f"{first} + 1")
    taken = (
        F.when(F.col("q_size") == 0, 0)
        .when(F.expr(f"{first} = {last}"), F.col("q_size") * once(first))
        .otherwise(F.expr(f"({first} + 1) * {block_words} - q_start") * once(first) + F.expr(f"q_end - {last} * {block_words}") * once(last) + block_words * inner)
    )
    middle = f"((q_start + q_size div 2) div {block_words})"
    copies = F.when(F.col("q_size") == 0, 0).otherwise(once(middle))
    return dealt.withColumns({"q_taken": taken.cast("long"), "q_copies": copies.cast("int")}).select("q_file", "q_row", "doc_id", "source", "q_size", "q_source_size", "q_target", "q_taken", "q_copies")


def op6(spark, sf_dir: str) -> DataFrame:
    mixed = allot(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("q_size").alias("size"), F.col("q_source_size").alias("source_size"), F.col("q_target").alias("target"), F.col("q_taken").alias("taken"), "source")


def mix(documents: DataFrame, **how) -> DataFrame:
    """Every row of `documents` with q_size, q_source_size, q_target, q_taken and q_copies, which replace columns of these names."""
    own = without(documents, ADDED)
    safe = placed(aside(own, "doc_id", "source", "text"))
    out = safe.join(allot(safe, **how).drop("doc_id", "source"), ["q_file", "q_row"])
    return out.select(*safe.columns[:-2], *ADDED).toDF(*own.columns, *ADDED)


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The mix as whole documents: each as often as the block of its middle word is taken, so that a source's words come near its target. All columns of `documents`, whatever their names."""
    safe = placed(aside(documents, "doc_id", "source", "text"))
    taken = allot(safe, **how).where("q_copies > 0").select("q_file", "q_row", "q_copies")
    mixed = safe.join(taken, ["q_file", "q_row"]).withColumn("q_copy", F.explode(F.sequence(F.lit(1), F.col("q_copies"))))
    return mixed.select(*safe.columns[:-2]).toDF(*documents.columns)
