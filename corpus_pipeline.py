"""From raw documents to training sequences, one operator per stage.

Each stage takes the documents its predecessor kept and returns documents (the last one returns pieces of sequences):

1. quality rules: documents that fail a rule of policy v2 go;
2. language: documents whose language is not recognised go;
3. near duplicates: of each group (shingles of five words, similarity 0.8 or more) the least doc_id stays;
4. repeated passages: bytes that an earlier document holds are cut out, and ``n_chars`` follows the text;
5. packing: sequences of 1024 ids.

Stages are written as Parquet in the shared folder and read again, so each starts from a file and survives lost executors.
Null texts fail the first stage; an empty table runs through to an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import chosen_path, lang_id, packing, quality_rules, suffix_dedup
from broadsheet.llm.common import stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs, "v2")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]
#: language and near duplicates have no SQL; a brute-force test stands for it
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
