"""The corpus pipeline: each stage reads what its predecessor wrote and applies one operator.

A stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of ``documents``,
and further columns of their input, whatever their names. Each takes nulls in any column, empty and
very long texts, repeated rows and empty tables; its docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergraph.llm import decontaminate, mixing, near_dedup, quality_rules, suffix_dedup
from covergraph.llm._common import materialize, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows texts that were cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie in the perplexity band of their language.

    Null and empty texts have too few words and go; a null language is one of its own; repeated rows are judged alike.
    """
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies: the one with the smallest id, of several texts under it that with the smallest digest.

    Null texts are copies of each other, as empty ones are; of repeated rows one stays; rows without an id stay.
    """
    return near_dedup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that occur earlier: in a smaller id, or before in the same text.

    Null ids come first; null texts stay null; of texts under one id that with the smaller digest is earlier, and equal rows are
    cut alike. A text that is cut as a whole stays as an empty one.
    """
    return _counted(suffix_dedup.remove(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents that are mostly such passages go.

    Null and empty texts have no words and stay; every row is judged by itself; items without words are no item.
    """
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's decisions: one row per document with how often it is emitted and its source's target; ``mixing.emit`` makes the rows.

    A null text has size 0, a null source is the last source, a null id is ordered first; repeated rows are decided each.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("mixing", mixture),
]

#: The perplexity model, signatures and suffix order are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
