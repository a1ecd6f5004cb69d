"""Topic prompts out, completions in.

search_results: source_pos INT, rank INT, title STRING, content STRING
completions: source_pos INT, payload STRING (one response per source)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import dates
from broadsheet.functions.textops import blank_to_null, first_filled, paragraphs, strip_fences
from broadsheet.operators import filters
from broadsheet.sources import registry

_RESPONSE = "choices array<struct<message:struct<content:string>>>"
EMPTY = "Failed to get analysis from LLM"
# Fields of a prompt template: {date} {topic} {goal} {context}.
TEMPLATE = "日期: {date}\n主题: {topic}\n目标: {goal}\n{context}\n请就以上主题写一份有事实依据的分析。\n"
CONTEXT_HEAD = "\n搜索结果\n"


def search_context(search_results: DataFrame) -> DataFrame:
    """The best ranked results of each topic as numbered lines: source_pos, context."""
    # each task keeps its own best few before the shuffle, so a topic never gathers all its results
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("source_pos").orderBy("rank"))
    top = search_results.withColumn("_i", rank).filter(F.col("_i") <= fv.MAX_SEARCH_RESULTS)
    line = F.concat(
        F.lit("["), F.col("_i").cast("string"), F.lit("] "), F.coalesce("title", F.lit("None")), F.lit(": "),
        F.coalesce("content", F.lit("None")), F.lit("\n"),
    )
    return top.groupBy("source_pos").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", line.alias("line")))), lambda r: r["line"]), "").alias("context")
    )


def _fill(template: str, fields: dict[str, Column]) -> Column:
    text = F.lit(template)
    for name, value in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def build_prompts(
    sources: DataFrame, search_results: DataFrame, as_of: Column, template: str = TEMPLATE, default_model: str = fv.DEFAULT_MODEL
) -> DataFrame:
    """One prompt per topic with its model; a topic without results has no context block."""
    day = dates.as_of_day(as_of)
    shown = F.concat(F.substring(day, 1, 4), F.lit("年"), F.substring(day, 6, 2), F.lit("月"), F.substring(day, 9, 2), F.lit("日"))
    topics = sources.filter(F.col("type") == "trending").select("source_pos", "src", "goal", "model")
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit(CONTEXT_HEAD), F.col("context"))).otherwise("")
    prompt = _fill(
        template, {"date": shown, "topic": F.col("src"), "goal": F.coalesce("goal", F.lit(fv.DEFAULT_TREND_GOAL)), "context": context}
    )
    return topics.join(search_context(search_results), "source_pos", "left").select(
        "source_pos", prompt.alias("prompt"), F.coalesce(blank_to_null(F.col("model")), F.lit(default_model)).alias("model")
    )


def parse(completions: DataFrame, sources: DataFrame, as_of: Column, searched: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One article per topic dated with the run's day; an empty completion is a failed run."""
    text = F.get(F.from_json("payload", _RESPONSE)["choices"], F.lit(0))["message"]["content"]
    # exploded, a text is read once: a plain column would be read again by the filter on it, which moves below the joins
    texts = completions.select("source_pos", F.explode(F.array(text)).alias("text"))
    read = filters.with_source(texts, sources, ["src", "title", "goal", "model"])
    good = F.coalesce(F.col("text"), F.lit("")) != ""
    runs = read.select("source_pos", good.alias("success"), F.when(~good, EMPTY).alias("error"))
    if searched is not None:
        hits = searched.select("source_pos").distinct().withColumn("_hit", F.lit(True))
        read = read.join(hits, "source_pos", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    else:
        read = read.withColumn("_hit", F.lit(False))
    rows = read.filter(good).select(
        "source_pos",
        F.lit(0).alias("item_pos"),
        first_filled(F.col("title"), F.concat(F.lit(fv.DEFAULT_TREND_TITLE), F.col("src"))).alias("title"),
        paragraphs(strip_fences(F.col("text"))).alias("content"),
        F.col("src").alias("url"),
        F.lit(fv.TREND_AUTHOR).alias("author"),
        dates.as_of_day(as_of).alias("published_date"),
        F.create_map(
            F.lit("goal"), F.col("goal"), F.lit("model"), F.coalesce(blank_to_null(F.col("model")), F.lit("default")),
            F.lit("has_search_context"), F.col("_hit").cast("string"),
        ).alias("metadata"),
    )
    return registry.as_articles(rows), registry.as_runs(runs)


@registry.source("trending", {"goal": "string"})
def adapter(ctx: registry.Context) -> tuple[DataFrame, DataFrame]:
    return parse(ctx.landing("trending"), ctx.sources, F.lit(ctx.as_of).cast("timestamp"), ctx.landing("search"))
