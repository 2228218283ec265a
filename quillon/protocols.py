"""What users can put in place of the engine's own parts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame

from .operators.filters import Condition


class DataSource(Protocol):
    def read(self) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected) entities."""


class VectorStore(Protocol):
    def search(self, query: list[float], k: int, whitelist: DataFrame | None = None) -> DataFrame:
        """id, entity_id, score of the best k."""

    def upsert(self, points: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...


class QueryEmbedder(Protocol):
    def embed(self, text: Column) -> Column:
        """A vector column; a remote model runs in a pandas UDF over batches."""


class Compiler(Protocol):
    def compile(self, sources: DataFrame) -> DataFrame:
        """Evidence of a page per source; a remote model runs in mapInPandas."""


class Reranker(Protocol):
    def rerank(self, hits: DataFrame, query: str) -> DataFrame: ...


class FilterRelaxer(Protocol):
    def __call__(self, conditions: list[Condition]) -> list[Condition] | None: ...


class ConsistencyArbiter(Protocol):
    def arbitrate(self, claims: DataFrame) -> DataFrame: ...
