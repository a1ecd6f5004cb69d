"""Article rows: union of sources, cleaning under each source's rules, rule warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import clean as bodies
from broadsheet.functions import rules
from broadsheet.operators import filters


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Rows of all sources; (source_pos, item_pos) keeps the configured order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def clean(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Every body cleaned under its source's rules; a narrow projection after a small-side join."""
    ruled = filters.with_source(articles, sources, ["keep_link", "exclude"])
    cleaned = bodies.clean_bodies(ruled, "content", "url", "images", "keep_link", "exclude", "content")
    return cleaned.drop("keep_link", "exclude")


def rule_warnings(sources: DataFrame) -> DataFrame:
    """Exclude rules that have no effect, with the reason."""
    listed = sources.select("source_pos", F.posexplode("exclude").alias("rule_pos", "rule"))
    return listed.withColumn("warning", rules.rule_problem(F.col("rule"))).filter(F.col("warning").isNotNull()).select(
        "source_pos", "rule_pos", F.col("rule.type").alias("type"), "warning"
    )
