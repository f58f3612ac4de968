"""A corpus pipeline: reject poor documents, drop exact and near copies, mix sources to target weights, pack into sequences.

Every stage works on all that its predecessor kept and is written as Parquet, in the folder that executors share, before the next reads
it; what a stage wrote is deleted once the next one's result is written. All but the last return the columns of documents.

Defined cases: a null text counts as empty in every stage; the classifier scores empty texts like others; of equal texts (empty ones
too) the row with the smallest doc_id stays, null ids coming last, and of rows that are equal in both, one; texts without words are near
copies of nothing; null sources are a source of their own; a document of no words is never taken by the mix, a source of no words gives
none; extra columns are kept, whatever their names; without documents every stage gives none, and without labels of both classes the
classifier keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import _text, exact_dedup, mixing, ngram_join, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return ngram_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.digests(packing.pack(docs, with_ids=True))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("ngram_join", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: No stage but the second can be put in SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _text.table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = _text.materialise(stage(spark, docs, sf_dir))
        if before is not None:
            _text.remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
