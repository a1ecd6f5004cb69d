"""Landed web pages to articles.

pages: source_pos INT, url STRING, html STRING (one page per source)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import clean, images
from broadsheet.operators import filters
from broadsheet.sources import registry

EMPTY = "Failed to extract content from webpage"


def to_articles(pages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One article per page; a page without a body is a failed run."""
    html, url = F.col("html"), F.col("src")
    read = filters.with_source(pages.drop("url"), sources, ["src", "title"]).select(
        "source_pos",
        F.lit(0).alias("item_pos"),
        clean.page_title(html, F.col("title"), url).alias("title"),
        clean.main_content(html).alias("content"),
        url.alias("url"),
        images.merge(images.extract_cover(html, url), images.extract(html, url)).alias("images"),
    )
    runs = pages.select(
        "source_pos", (clean.main_content(html) != "").alias("success")
    ).withColumn("error", F.when(~F.col("success"), EMPTY))
    return registry.as_articles(read.filter(F.col("content") != "")), registry.as_runs(runs)


@registry.source("web")
def adapter(ctx: registry.Context) -> tuple[DataFrame, DataFrame]:
    articles, runs = to_articles(ctx.landing("web"), ctx.sources)
    return filters.drop_titles(articles, ctx.sources), runs
