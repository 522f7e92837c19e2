"""A corpus made ready for training: five stages over the table documents, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, langid, packing, simhash, substring
from corpusloom.llm.common import read_table, saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know."""
    return langid.drop_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one of smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that start earlier in the corpus."""
    return substring.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in training sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("packing", packing_plan),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The models' verdicts and the packing can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
