"""Source configuration: the JSON document, its defaults, and validation as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv

ENTRY = (
    "type string, src string, priority string, title string, keep_link string, full_text string, "
    "exclude array<struct<type:string,value:string>>, `delete` string, goal string, model string, "
    "metadata map<string,string>"
)
DOCUMENT = f"title struct<text:string,img:string>, limit int, body array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in ENTRY.split(', '))}>>"


class ConfigError(ValueError):
    """The configuration document cannot be used at all."""


def option(metadata: Column, key: str, cast: str = "string") -> Column:
    """One metadata value, null when absent or unreadable as ``cast``."""
    return F.try_element_at(metadata, F.lit(key)).try_cast(cast)


def shape(body: DataFrame) -> DataFrame:
    """Defaults on raw source entries that carry ``source_pos``."""
    return body.select(
        F.col("source_pos").cast("int").alias("source_pos"),
        "type",
        "src",
        F.coalesce(F.col("priority").try_cast("int"), F.lit(0)).alias("priority"),
        "title",
        F.coalesce("keep_link", F.lit("Y")).alias("keep_link"),
        F.coalesce("full_text", F.lit("N")).alias("full_text"),
        "exclude",
        "delete",
        "goal",
        "model",
        "metadata",
    )


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row.  A missing title or a missing or mistyped body is an error."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("value"), F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"}).alias("doc")
    )
    checks = raw.select(
        F.get_json_object("value", "$.title").isNotNull().alias("title"),
        F.coalesce(F.get_json_object("value", "$.body").rlike(r"^\s*\["), F.lit(False)).alias("body"),
        F.col("doc").isNotNull().alias("json"),
    ).first()
    if checks is None or not checks["json"]:
        raise ConfigError(f"no readable configuration at {path}")
    if not checks["title"]:
        raise ConfigError("title is required")
    if not checks["body"]:
        raise ConfigError("body must be an array")
    return raw.select("doc.*")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Sources of the document in array order, defaults filled in."""
    entries = read_document(spark, path).select(F.posexplode("body").alias("source_pos", "s"))
    return shape(entries.select("source_pos", "s.*"))


def read_limit(spark: SparkSession, path: str) -> int:
    """The global limit of items per source."""
    return read_document(spark, path).select(F.coalesce("limit", F.lit(fv.DEFAULT_LIMIT))).first()[0]


def read_title(spark: SparkSession, path: str) -> DataFrame:
    """Edition title text and image."""
    return read_document(spark, path).select(
        F.coalesce(F.col("title.text"), F.lit("Daily News")).alias("text"), F.col("title.img").alias("img")
    )


def validate(sources: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Usable sources and rejected ones with a reason; a trend source without a goal gets the default goal."""
    reason = F.when(~F.coalesce(F.col("type").isin(types), F.lit(False)), F.concat(F.lit("Invalid type: "), F.coalesce("type", F.lit("None")))).when(
        F.coalesce(F.col("src"), F.lit("")) == "", "src is required"
    )
    checked = sources.withColumn("reason", reason)
    goal = F.when((F.col("type") == "trending") & (F.coalesce("goal", F.lit("")) == ""), fv.DEFAULT_TREND_GOAL).otherwise(F.col("goal"))
    ok = checked.filter(F.col("reason").isNull()).drop("reason").withColumn("goal", goal)
    return ok, checked.filter(F.col("reason").isNotNull()).select("source_pos", "type", "src", "reason")
