"""Per-source limits and title filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions.fold import let
from broadsheet.functions.textops import strip
from broadsheet.operators import numbering
from broadsheet.sources.config import option


def with_source(articles: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """Article rows with columns of their source's configuration."""
    return articles.join(sources.select("source_pos", *columns), "source_pos")


def limit_per_source(
    articles: DataFrame, sources: DataFrame, global_limit: int = fv.DEFAULT_LIMIT, dense: bool = False
) -> DataFrame:
    """First items of each source in feed order; ``metadata.limit`` replaces the global limit.

    With ``dense`` positions (0, 1, 2, ... per source, as the feed readers number them) this is a filter.
    """
    limits = sources.select(
        "source_pos",
        F.coalesce(option(F.col("metadata"), "limit", "int"), F.lit(global_limit)).alias("_limit"),
    )
    limited = articles.join(limits, "source_pos")
    if dense:
        return limited.filter(F.col("item_pos") < F.col("_limit")).drop("_limit")
    top = limits.agg(F.max("_limit")).first()[0]
    return numbering.first_n(limited, ["source_pos"], "item_pos", "_limit", int(top or 0)).drop("_limit")


def title_hits(title: Column, delete: Column) -> Column:
    """Whether the title holds one of the comma-separated keywords (trimmed, case-sensitive; '' matches any title)."""
    hit = let(title, lambda t: F.exists(F.split(delete, ",", -1), lambda k: t.contains(strip(k))))
    return F.when(F.coalesce(delete, F.lit("")) == "", False).otherwise(F.coalesce(hit, F.lit(False)))


def drop_titles(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles whose title no delete keyword of their source matches."""
    joined = with_source(articles, sources, ["delete"])
    return joined.filter(~title_hits(F.col("title"), F.col("delete"))).drop("delete")
