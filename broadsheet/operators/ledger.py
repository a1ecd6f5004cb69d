"""Content ids and the ledger of ids already published.

ledger: content_id STRING, run_id BIGINT, ord BIGINT; (run_id, ord) is the insertion order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import urls
from broadsheet.functions.textops import strip
from broadsheet.operators import numbering

SCHEMA = "content_id string, run_id bigint, ord bigint"
ROW_KEY = ["source_pos", "item_pos"]


def content_id(url: Column, title: Column | None = None, published_date: Column | None = None) -> Column:
    """md5 of the normalised address, then title and date where they are not empty."""
    def part(c: Column | None) -> Column:
        if c is None:
            return F.lit("")
        return F.when(c != "", F.concat(F.lit("|"), c)).otherwise("")

    return F.md5(F.concat(urls.normalize(url), part(title), part(published_date)).cast("binary"))


def with_ids(articles: DataFrame) -> DataFrame:
    return articles.withColumn("content_id", content_id(F.col("url"), F.col("title"), F.col("published_date")))


# --- reading, writing -----------------------------------------------------------------------------------------------
def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The parquet ledger; a missing one is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A line-per-id ledger file as run 0: trimmed, blank lines skipped, in file order."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    lines = spark.read.text(path).select(
        strip(F.col("value")).alias("content_id"), F.lit(0).cast("bigint").alias("run_id"),
        F.monotonically_increasing_id().alias("ord"),
    )
    return lines.filter(F.col("content_id") != "")


def append(spark: SparkSession, new_ids: DataFrame, path: str, run_id: int) -> None:
    """Write the ids of one run into that run's partition; a repeated run overwrites itself, an empty one leaves it empty.

    ``new_ids`` (content_id, ord) must not be computed from that same partition.
    """
    rows = new_ids.select("content_id", F.col("ord").cast("bigint").alias("ord"))
    rows.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


# --- duplicates -----------------------------------------------------------------------------------------------------
def first_keys(articles: DataFrame) -> DataFrame:
    """One row per content id with the key of its first article; pre-aggregated, only keys are shuffled."""
    return (
        articles.groupBy("content_id")
        .agg(F.min(F.struct(*ROW_KEY)).alias("_first"))
        .select("content_id", *[F.col(f"_first.{k}").alias(k) for k in ROW_KEY])
    )


def first_occurrence(articles: DataFrame) -> DataFrame:
    """Articles that are the first of their content id in (source, item) order."""
    return articles.join(first_keys(articles).select(*ROW_KEY), ROW_KEY, "left_semi")


def new_keys(articles: DataFrame, ledger: DataFrame) -> DataFrame:
    """First keys whose id the ledger lacks.  Ids are unique on both sides by then, so no key is hot."""
    return first_keys(articles).join(ledger.select("content_id"), "content_id", "left_anti")


def new_articles(articles: DataFrame, ledger: DataFrame) -> DataFrame:
    """First occurrences that are not in the ledger; article bodies are shuffled once, on the unique row key."""
    return articles.join(new_keys(articles, ledger).select(*ROW_KEY), ROW_KEY, "left_semi")


def _by_id(articles: DataFrame, ledger: DataFrame, how: str) -> DataFrame:
    ids = articles.select("content_id").distinct().join(ledger.select("content_id"), "content_id", "left_semi")
    return articles.join(ids, "content_id", how)


def new_only(articles: DataFrame, ledger: DataFrame) -> DataFrame:
    """Articles whose id is not in the ledger."""
    return _by_id(articles, ledger, "left_anti")


def seen_only(articles: DataFrame, ledger: DataFrame) -> DataFrame:
    """Articles whose id is in the ledger."""
    return _by_id(articles, ledger, "left_semi")


def union_new(ledger: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Ledger and the ids it lacks."""
    fresh = new_ids.select("content_id").distinct().join(ledger.select("content_id"), "content_id", "left_anti")
    return ledger.select("content_id").unionByName(fresh)


# --- size -----------------------------------------------------------------------------------------------------------
def cutoff(ledger: DataFrame, cap: int = fv.LEDGER_CAP, width: int = numbering.WIDTH) -> DataFrame:
    """One row ``(run_id, ord)``: the oldest record to keep; no row when the ledger is within the cap.

    Records are counted per run first, then per bucket of the one run that straddles the cap; only the one bucket that
    straddles it is ranked.
    """
    from pyspark.sql import Window as W

    keyed = ledger.select("run_id", "ord", numbering.bucket("ord", width).alias("_b"))

    def straddling(counts: DataFrame, window) -> DataFrame:
        running = counts.withColumn("_upto", F.col("_before") + F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, 0)))
        return running.filter((F.col("_upto") > cap) & (F.col("_upto") - F.col("_n") <= cap))

    per_run = keyed.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.lit(0))
    run = straddling(per_run, W.orderBy(F.desc("run_id"))).select("run_id", (F.col("_upto") - F.col("_n")).alias("_before"))
    per_bucket = keyed.join(run, "run_id").groupBy("run_id", "_b", "_before").agg(F.count(F.lit(1)).alias("_n"))
    edge = straddling(per_bucket, W.partitionBy("run_id").orderBy(F.desc("_b"))).select(
        "run_id", "_b", (cap - (F.col("_upto") - F.col("_n"))).alias("_room")
    )
    # a bucket with no room left is dropped whole: the record after it is the first to keep
    ranked = keyed.join(edge, ["run_id", "_b"]).withColumn(
        "_rn", F.row_number().over(W.partitionBy("run_id", "_b").orderBy(F.desc("ord")))
    )
    return ranked.filter(F.col("_rn") == F.col("_room") + 1).agg(
        F.max(F.struct("run_id", "ord")).alias("last_dropped")
    )


def compact(ledger: DataFrame, cap: int = fv.LEDGER_CAP, width: int = numbering.WIDTH) -> DataFrame:
    """Newest ``cap`` records; a ledger within the cap is unchanged.  The cut is one scalar, the rest a filter."""
    last_dropped = cutoff(ledger, cap, width).scalar()
    return ledger.filter(F.coalesce(F.struct("run_id", "ord") > last_dropped, F.lit(True)))


def stats(ledger: DataFrame, run_id: int) -> DataFrame:
    """Distinct ids in all, and ids of the given run."""
    return ledger.agg(
        F.count_distinct("content_id").alias("total_fetched"),
        F.count_if(F.col("run_id") == run_id).alias("new_fetched"),
    )
