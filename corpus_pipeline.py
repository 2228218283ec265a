"""The corpus pipeline: filter, deduplicate, decontaminate, mix, and write token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
stage's rows as Parquet in the shared folder and reads them back as the next
stage's documents, so that a lost executor costs one stage at most. Empty tables
give no rows; all stages but the last return the columns of documents, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import materialize, table
from quillon.llm.decontaminate import decontaminate
from quillon.llm.jaccard import one_of_each
from quillon.llm.mixing import mixed_documents
from quillon.llm.quality import kept
from quillon.llm.tokenbin import token_rows


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer keeps; null and wordless texts go, repeated rows are judged alike."""
    return kept(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, the first by doc_id and place; rows without words or without an id stay."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item of eight words or more has a window; null texts stay, an empty benchmark removes nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents, up to three times each, so that every source's words come near its target; wordless texts are never taken, a null source is one of its own."""
    return mixed_documents(docs)


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the id files, how many they are, and their checksum; a null text has the end id alone."""
    return token_rows(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_id_output),
]

#: The stages are iterative or train a model, which SQL doesn't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
