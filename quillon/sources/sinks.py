"""Sinks: published generations, vector collections, reports, search-engine export.

A published table is a folder of generations and a pointer. A generation is
written whole, read back and verified; only then does the pointer's newest row
name it, so readers see the old or the new one, never a mixture.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ROWS = 1000
POINTER = "generation long, path string, n_rows long, digest decimal(38,0)"


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free sum of row hashes."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h)


class PublishedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def pointers(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], POINTER)
        return self.spark.read.schema(POINTER).parquet(f"{self.path}/pointer")

    def current(self) -> tuple[int, DataFrame] | None:
        row = self.pointers().orderBy(F.desc("generation")).first()
        if row is None:
            return None
        df = self.spark.read.parquet(row.path)
        if fingerprint(df) != (row.n_rows, int(row.digest)):
            raise RuntimeError(f"generation {row.generation} is corrupt")
        return row.generation, df

    def publish(self, df: DataFrame, force: bool = False) -> tuple[int, str]:
        """(generation, published or reused): rows equal to the live ones are not written again unless forced."""
        live = self.current()
        path = f"{self.path}/data-{uuid.uuid4().hex}"
        if live and not force and fingerprint(live[1]) == fingerprint(df):
            return live[0], "reused"
        df.write.parquet(path)
        n, digest = fingerprint(self.spark.read.parquet(path))
        if n != df.count():
            raise RuntimeError("read-back differs from what was written")
        generation = (live[0] if live else 0) + 1
        self.spark.createDataFrame([(generation, path, n, digest)], "generation long, path string, n_rows long, digest string").withColumn("digest", F.col("digest").cast("decimal(38,0)")).write.mode("append").parquet(f"{self.path}/pointer")
        return generation, "published"


class AppendLog:
    """An append-only table (query log, rejection audit): rows get ids that rise from append to append."""

    def __init__(self, spark: SparkSession, path: str, id_column: str):
        self.spark, self.path, self.id = spark, path.rstrip("/"), id_column
        self.batches = 0

    def append(self, rows: DataFrame) -> DataFrame:
        """The rows as written, with their ids: 18 bits of batch, 17 of partition, 28 of row, given once while writing."""
        path = f"{self.path}/batch={self.batches}"
        place = F.monotonically_increasing_id()  # partition above 33 bits of row
        number = F.lit(self.batches << 45) + F.shiftright(place, 33) * (1 << 28) + place % (1 << 33)
        rows.select(number.alias(self.id), "*").write.parquet(path)
        self.batches += 1
        return self.spark.read.parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/batch={k}" for k in range(self.batches)])


class VectorCollection:
    """Points (id, vec, entity_id and more) of one dimension and distance, as a published table: changes are generations."""

    def __init__(self, spark: SparkSession, path: str, dims: int):
        self.table, self.dims, self.spark = PublishedTable(spark, path), dims, spark

    def ensure(self, schema: str = "id bigint, vec array<double>, entity_id string") -> None:
        """Create the collection if it isn't there."""
        if self.table.current() is None:
            self.recreate(schema)

    def recreate(self, schema: str = "id bigint, vec array<double>, entity_id string") -> None:
        self.table.publish(self.spark.createDataFrame([], schema), force=True)

    def points(self) -> DataFrame:
        return self.table.current()[1]

    def upsert(self, points: DataFrame) -> None:
        """Points replace those of the same id; vectors of another length are refused."""
        if not points.where((F.size("vec") != self.dims) | F.col("vec").isNull()).isEmpty():
            raise ValueError(f"vectors must have {self.dims} numbers")
        live = self.points()
        self.table.publish(live.join(points.select("id"), "id", "left_anti").unionByName(points.select(*live.columns)))

    def delete(self, ids: DataFrame) -> None:
        self.table.publish(self.points().join(ids.select("id"), "id", "left_anti"))

    def search(self, query: list[float], k: int, distance: str = "cosine", whitelist: DataFrame | None = None) -> DataFrame:
        from ..operators.vectors import vector_topk

        return vector_topk(self.points(), query, k, distance, whitelist)


def write_report(spark: SparkSession, doc: dict, path: str, titles: dict[str, str] | None = None) -> None:
    """A report's JSON and Markdown files, written aside and renamed into place, so that readers never see a part."""
    named = {titles.get(k, k) if titles else k: v for k, v in doc.items()}
    hadoop = spark._jvm.org.apache.hadoop.fs
    for suffix, text in ((".json", canonical_json(doc)), (".md", markdown(named))):
        aside, there = hadoop.Path(f"{path}{suffix}.part"), hadoop.Path(f"{path}{suffix}")
        fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(there):
            fs.delete(there, False)
        fs.rename(aside, there)


def point_id(entity: F.Column, chunk: F.Column, generation: F.Column) -> F.Column:
    """Deterministic UUID-shaped id of a vector point."""
    h = F.sha2(F.concat_ws("\n", entity, chunk, generation.cast("string")), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def search_documents(pages: DataFrame) -> DataFrame:
    """Accepted pages as JSON documents, one per row, for a search engine's bulk interface."""
    return pages.where("status = 'accepted'").select(F.to_json(F.struct("page_id", "entity_id", "title", "content", "domain")).alias("value"))


def canonical_json(value) -> str:
    """Sorted keys, no spaces, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def report(sections: dict[str, DataFrame]) -> dict:
    """A report of small tables, with its hash; a section of over 1000 rows is an error, never cut."""
    out: dict = {}
    for name, df in sections.items():
        rows = [r.j for r in df.limit(REPORT_ROWS + 1).select(F.to_json(F.struct("*")).alias("j")).collect()]
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{name} has over {REPORT_ROWS} rows")
        out[name] = sorted((json.loads(r) for r in rows), key=canonical_json)
    return out | {"report_hash": hashlib.sha256(canonical_json(out).encode()).hexdigest()}


def markdown(doc: dict) -> str:
    """A report's tables as Markdown."""
    lines = []
    for name, rows in doc.items():
        if not isinstance(rows, list):
            continue
        lines += [f"## {name}", ""]
        columns = sorted({k for r in rows for k in r})
        lines += ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *("| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows), ""]
    return "\n".join(lines)
