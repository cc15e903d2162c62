"""The training-data pipeline over documents: STAGES in order, run, and its SQL.

Each stage is called as ``stage(spark, docs, sf_dir)`` and written before the
next one reads it.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossier.functions.storage import written
from dossier.llm import decontaminate, lines, ngram_join, packing, quality

#: None: expectation maximisation and tokenising have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def _aside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply an operator to doc_id and text; other columns have names meanwhile that it cannot add, and come back as they were."""
    own = {name: f"__own_{i}" for i, name in enumerate(docs.columns) if name not in ("doc_id", "text")}
    done = operator(docs.withColumnsRenamed(own))
    return done.select(*[F.col(own.get(name, name)).alias(name) for name in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision posterior and the base rules keep.

    Null and empty texts go; equal texts and repeated rows share a verdict; a
    text of any length is counted whole; an empty table stays empty; other
    columns come back as they were.
    """
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three lines in a row go; ``n_chars`` counts what is left.

    A null text stays null, with null ``n_chars``; a document that loses all its
    lines stays with an empty text; of equal passages the one with the smallest
    doc_id stays; rows that repeat a doc_id count as one document.  An empty
    table stays empty; other columns come back as they were.
    """
    done = _aside(docs, lines.dedup_lines)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every component of five-word sets with similarity 0.8 or more.

    Null and empty texts are linked with nothing and stay; rows that repeat a
    kept doc_id stay; rows without a doc_id stay.  An empty table stays empty;
    other columns come back as they were.
    """
    return ngram_join.one_per_component(docs, words=5, over=4, under=5).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    Null and empty texts have no words and stay; each row is judged by itself,
    so repeated rows stay or go together; texts are read whole.  An empty table
    stays empty; other columns come back as they were.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _aside(docs, lambda rows: decontaminate.find_contamination(rows, benchmark).filter("NOT contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, placed in sequences of 1024 tokens.

    A null text packs as an empty one; equal texts and repeated rows are packed
    each; an empty table gives no piece; other columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else written(docs, f"pipeline-{name}")
    return docs
