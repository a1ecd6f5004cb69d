"""Bookmark API payloads to articles.

payloads: source_pos INT, payload STRING (one response per source)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions.textops import blank_to_null
from broadsheet.operators import filters
from broadsheet.sources import registry
from broadsheet.sources.feeds import page_bodies

_RESPONSE = "result boolean, message string, items array<struct<title:string,link:string,excerpt:string,cover:string>>"


def parse(
    payloads: DataFrame,
    pages: DataFrame | None,
    sources: DataFrame,
    global_limit: int = fv.DEFAULT_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """First bookmarks as articles; the page body replaces the excerpt where full text is asked for and found."""
    read = payloads.select("source_pos", F.from_json("payload", _RESPONSE).alias("r"))
    good = F.coalesce(F.col("r.result"), F.lit(False))
    runs = read.select(
        "source_pos",
        good.alias("success"),
        F.when(~good, F.concat(F.lit("Raindropio API error: "), F.coalesce("r.message", F.lit("Unknown error")))).alias("error"),
    )
    items = read.filter(good).select("source_pos", F.posexplode(F.slice("r.items", 1, global_limit)).alias("item_pos", "e"))
    e = F.col("e")
    rows = items.select(
        "source_pos",
        "item_pos",
        e["title"].alias("title"),
        F.concat(F.lit("<p>"), F.coalesce(e["excerpt"], F.lit("")), F.lit("</p>")).alias("content"),
        e["link"].alias("url"),
        F.array_compact(F.array(blank_to_null(e["cover"]))).alias("images"),
    )
    if pages is not None:
        flagged = filters.with_source(rows, sources, ["full_text"])
        full = flagged.filter(F.col("full_text") == "Y").drop("full_text")
        bodies = page_bodies(pages, full.select("url")).select("url", blank_to_null(F.col("body")).alias("body"))
        joined = full.join(bodies, "url", "left")
        full = joined.withColumn("content", F.coalesce("body", "content")).drop("body")
        rows = flagged.filter(F.col("full_text") != "Y").drop("full_text").unionByName(full)
    return registry.as_articles(rows), registry.as_runs(runs)


@registry.source("raindropio", {"full_text": "string"})
def adapter(ctx: registry.Context) -> tuple[DataFrame, DataFrame]:
    articles, runs = parse(ctx.landing("raindropio"), ctx.landing("pages"), ctx.sources, ctx.global_limit)
    return filters.drop_titles(articles, ctx.sources), runs
