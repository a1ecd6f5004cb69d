"""Run statistics: totals, per-source detail, errors, kept and original counts.

runs: source_pos INT, success BOOLEAN, error STRING, source_title STRING
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions.textops import blank_to_null


def per_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_pos").agg(F.count(F.lit(1)).alias("n_articles"))


def run_summary(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """Sources, succeeded, failed, articles of the run."""
    totals = runs.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("success")).alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    n = articles.agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.withColumn("articles", n)


def source_summary(runs: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: type, display name, status, new articles or the error."""
    joined = runs.join(sources.select("source_pos", "type", "src", "title"), "source_pos").join(
        per_source(articles), "source_pos", "left"
    )
    return joined.select(
        "source_pos",
        F.upper("type").alias("type"),
        F.coalesce(blank_to_null(F.col("source_title")), blank_to_null(F.col("title")), F.col("src")).alias("name"),
        "success",
        F.when(F.col("success"), F.coalesce("n_articles", F.lit(0))).alias("new_articles"),
        F.when(~F.col("success"), F.coalesce(blank_to_null(F.col("error")), F.lit(fv.UNKNOWN_ERROR))).alias("error"),
    )


def dedup_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """Kept and original article counts per source."""
    original = per_source(before).withColumnRenamed("n_articles", "original")
    kept = per_source(after).withColumnRenamed("n_articles", "kept")
    return original.join(kept, "source_pos", "left").select(
        "source_pos", F.coalesce("kept", F.lit(0)).alias("kept"), "original"
    )


def error_log(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """One line per failed source, ordered by ``source_pos``."""
    failed = runs.filter(~F.col("success")).join(sources.select("source_pos", "type", "src"), "source_pos")
    return failed.select(
        "source_pos",
        F.concat(
            F.lit("["), F.col("type"), F.lit("] "), F.col("src"), F.lit(": "), F.coalesce(F.col("error"), F.lit("None"))
        ).alias("line"),
    )
