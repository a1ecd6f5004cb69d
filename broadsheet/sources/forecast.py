"""Weather API payloads to articles.

payloads: source_pos INT, geo STRING, daily STRING (two responses per source)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions.textops import strip
from broadsheet.operators import filters
from broadsheet.sources import registry
from broadsheet.sources.config import option

_FIELDS = sorted({f for text in [fv.FORECAST_TITLE, *[p for _, p in fv.FORECAST_PARAGRAPHS]] for f in re.findall(r"\{(\w+)\}", text)} - {"city"})
_DAY = "struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ">"
_GEO = "code string, msg string, location array<struct<id:string,name:string>>"
_DAILY = f"code string, msg string, daily array<{_DAY}>"
# Address the reports are filed under; the fragment is not part of the content id.
REPORT_URL = "https://forecast.invalid/daily"


def _fill(template: str, day: Column, city: Column) -> Column:
    """A template with the fields of the day in it."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece == "{city}":
            parts.append(city)
        elif piece.startswith("{"):
            parts.append(F.coalesce(day[piece[1:-1]], F.lit("N/A")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def render(day: Column, city: Column) -> tuple[Column, Column]:
    """Title and body of a report."""
    body = F.concat(
        *[
            F.concat(F.lit(f"<p class='weather-item'><strong>{label}：</strong>"), _fill(text, day, city), F.lit("</p>"))
            for label, text in fv.FORECAST_PARAGRAPHS
        ]
    )
    return _fill(fv.FORECAST_TITLE, day, city), body


def pick_day(days: Column, wanted: Column) -> Column:
    """Day by keyword, index or date: tomorrow when nothing is asked for; null when there is no such day."""
    key = F.lower(strip(F.coalesce(wanted, F.lit("tomorrow"))))
    index = F.when(key.isin("today", "0"), 1).when(key.isin("tomorrow", "1"), 2).when(key == "2", 3)
    by_date = F.try_element_at(F.filter(days, lambda d: d["fxDate"] == key), F.lit(1))
    return F.when(index.isNotNull(), F.try_element_at(days, index)).otherwise(by_date)


def parse(payloads: DataFrame, sources: DataFrame, report_url: str = REPORT_URL) -> tuple[DataFrame, DataFrame]:
    """One report per source; an unknown city, an error code or a missing day is a failed run."""
    read = filters.with_source(
        payloads.select("source_pos", F.from_json("geo", _GEO).alias("g"), F.from_json("daily", _DAILY).alias("d")),
        sources,
        ["src", "metadata"],
    )
    place = F.try_element_at(F.col("g.location"), F.lit(1))
    wanted = option(F.col("metadata"), "date")
    found = read.select(
        "source_pos",
        "src",
        "g",
        "d",
        place["id"].alias("place_id"),
        F.coalesce(place["name"], F.col("src")).alias("city"),
        place.isNotNull().alias("located"),
        pick_day(F.col("d.daily"), wanted).alias("day"),
        wanted.alias("wanted"),
    )

    def api_error(r: str, what: str) -> Column:
        return F.concat(
            F.lit(f"Error from API ({what}): "), F.coalesce(F.col(f"{r}.code"), F.lit("None")), F.lit(" - "),
            F.coalesce(F.col(f"{r}.msg"), F.lit("Unknown error")),
        )

    asked = F.lower(strip(F.col("wanted")))
    error = (
        F.when(F.coalesce(F.col("g.code"), F.lit("")) != "200", api_error("g", "geo lookup"))
        .when(~F.col("located"), F.concat(F.lit("Could not resolve city '"), F.col("src"), F.lit("' via GeoAPI.")))
        .when(F.coalesce(F.col("d.code"), F.lit("")) != "200", api_error("d", "weather"))
        .when(F.coalesce(F.size("d.daily"), F.lit(0)) <= 0, "No forecast data available.")
        .when(F.col("day").isNull() & F.col("wanted").isNull(), fv.FORECAST_TOO_SHORT)
        .when(F.col("day").isNull() & asked.isin("tomorrow", "1"), fv.FORECAST_NO_TOMORROW)
        .when(F.col("day").isNull() & (asked == "2"), fv.FORECAST_NO_DAY_AFTER)
        .when(
            F.col("day").isNull(),
            F.concat(F.lit("Could not find forecast for date or index '"), F.coalesce("wanted", F.lit("tomorrow")), F.lit("'.")),
        )
    )
    checked = found.withColumn("error", error)
    good = checked.filter(F.col("error").isNull())
    title, body = render(F.col("day"), F.col("city"))
    rows = good.select(
        "source_pos",
        F.lit(0).alias("item_pos"),
        title.alias("title"),
        body.alias("content"),
        F.concat(F.lit(report_url + "#"), F.col("day.fxDate")).alias("url"),
        F.lit("QWeather").alias("author"),
        F.col("day.fxDate").alias("published_date"),
        F.create_map(F.lit("city"), F.col("city"), F.lit("location_id"), F.col("place_id")).alias("metadata"),
    )
    runs = checked.select(
        "source_pos",
        F.col("error").isNull().alias("success"),
        "error",
        F.when(F.col("error").isNull(), _fill(fv.FORECAST_SOURCE_TITLE, F.col("day"), F.col("city"))).alias("source_title"),
    )
    return registry.as_articles(rows), registry.as_runs(runs)


@registry.source("weather", {"metadata.date": "string"})
def adapter(ctx: registry.Context) -> tuple[DataFrame, DataFrame]:
    articles, runs = parse(ctx.landing("weather"), ctx.sources)
    return filters.drop_titles(articles, ctx.sources), runs
