"""Helpers that several operators share: table access, shared scratch, packed rows, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: the ASCII set of bytes.split().
UPPER_TO_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session on this machine alone (tests) may go without one: it gets a
    temporary folder. On a cluster a missing setting is an error, since every
    machine would write to a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, *measures: Column) -> tuple[DataFrame, dict]:
    """df written and read back, and aggregates of its rows taken while it is written."""
    seen = Observation()
    (df.observe(seen, *measures) if measures else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get if measures else {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table, which outlives any executor."""
    return stored(df, scratch(df.sparkSession, name))[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing will read any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _straight_scan(df: DataFrame) -> bool:
    """Whether df is nothing but columns and rows picked from one set of Parquet files."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "HadoopFsRelation" in plan.relation().getClass().getName() and plan.relation().fileFormat().toString() == "Parquet"


def placed(df: DataFrame, file: str = "q_file", row: str = "q_row") -> DataFrame:
    """df with two long columns that name each row by its file and its place in it.

    The name is the same in every scan, however the files are split, so that
    several passes may be joined on it. Rows that don't come straight from
    Parquet files are written first.
    """
    if not _straight_scan(df):
        df = materialize(df, "placed")
    meta = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give freed memory back: a worker process stays after its task and its pools would stay with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of bounded bytes: texts are long, and 10,000 rows of them may be gigabytes."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's default; a session's own choice stays
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df.mapInArrow(trimmed, schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """in_arrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return in_arrow(df, run, schema)


def text_slices(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text, without decoding."""
    data = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    for x in data:
        yield x.as_py()


def pieces(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text, so that numpy's working memory stays bounded; a longer text stands alone."""
    sizes = np.array([0 if s is None else s for s in pa.compute.binary_length(column).to_pylist()], np.int64)
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield start, i
            start, total = i, 0
        total += int(s)
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (fixed public constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = mix64(np.arange(1, 257, dtype=U) * BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown as needed."""
    have = _powers.__dict__.setdefault("table", (np.ones(1, U), np.ones(1, U)))
    if len(have[0]) < n:
        size = max(n, 1 << 17)
        up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 22:
            _powers.table = have
    return have


class Rolling:
    """64-bit hashes of any substring of a text."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum(BYTES[raw] * up[: len(raw)], out=self.sums[1:])

    def __call__(self, starts, size: int) -> np.ndarray:
        return mix64((self.sums[starts + size] - self.sums[starts]) * self.down[starts])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n])


SPACES = np.zeros(256, bool)
SPACES[list(b" \t\n\v\f\r")] = True


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all lower-cased words in order, number of words of each text), without a Python object per word."""
    raw = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]).translate(UPPER_TO_LOWER), np.uint8)
    word = ~SPACES[raw]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    rolling = Rolling(raw)
    hashes = mix64((rolling.sums[ends] - rolling.sums[starts]) * rolling.down[starts] + (ends - starts).astype(U))
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node but the smallest ones, for a task's edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _forests(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Edges (u, v) replaced by a spanning forest of stars, `most` edges of a task at a time: connects the same nodes with fewer edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0

        def out() -> pa.RecordBatch:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            us.append(batch.column("u").to_numpy()), vs.append(batch.column("v").to_numpy())
            held += batch.num_rows
            if held >= most:
                yield out()
                us, vs, held = [], [], 0
        if held:
            yield out()

    return in_arrow(edges.select("u", "v"), run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the graph reaches.

    A round has two steps, until neither changes anything. First all edges of a
    node meet where it is the larger end, and each task replaces its edges by a
    spanning forest of stars towards the smallest nodes. Then every edge whose
    smaller end has itself a smaller parent moves to that parent. Both keep what is
    connected connected, and a sum of labels falls with every change, so the
    rounds end; there is no limit on their number.

    Each step's table is written: no lineage grows, and a lost executor costs one
    step. A node with very many neighbours is not gathered: at its larger end a
    node has a few parents only, and the second step is a join between plain
    exchanges, of which Spark splits the skewed side.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    path = scratch(spark, "edges")
    now, seen = stored(_forests(start), path, F.count(F.lit(1)).alias("n"))
    while seen["n"]:
        stars, parents, moved = (scratch(spark, x) for x in ("stars", "parents", "edges"))
        met, had = stored(_forests(now.repartition(width(spark), "u")), stars, F.count(F.lit(1)).alias("n"))
        least, one = stored(met.groupBy(F.col("u").alias("p")).agg(F.min("v").alias("m")), parents, F.count(F.lit(1)).alias("n"))
        step = met.join(least, F.col("v") == F.col("p"), "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        after, seen = stored(step, moved, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("moved"), 1)).alias("moved"))
        discard(spark, path, stars, parents)
        now, path = after, moved
        if had["n"] == one["n"] and not seen["moved"]:  # one parent each, and that a root
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def aside(df: DataFrame, *needed: str) -> DataFrame:
    """df with every other column under a name of its own, so that none clashes with what an operator adds. `back` undoes it."""
    seen: set[str] = set()
    names = []
    for i, c in enumerate(df.columns):
        keep = c in needed and c not in seen
        seen.add(c)
        names.append(c if keep else f"_aside_{i}")
    return df.toDF(*names)


def back(out: DataFrame, renamed: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of `renamed` out of `out`, under the names that they have in df."""
    return out.select(*renamed.columns).toDF(*df.columns)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that bear one of the names: an operator's own columns replace them."""
    stay = [i for i, c in enumerate(df.columns) if c not in names]
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).select(*(f"_{i}" for i in stay)).toDF(*(df.columns[i] for i in stay))
