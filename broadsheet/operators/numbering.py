"""Ranks and running positions without putting one group into one task.

A position column is cut into buckets of ``WIDTH`` consecutive values.  Rows are counted per group and bucket (a
pre-aggregated, narrow shuffle), offsets are running sums over that small table, and ``row_number`` runs only inside a
bucket.  A bucket never holds more rows than its width, however large its group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 65_536


def bucket(pos: str, width: int) -> Column:
    return F.floor(F.col(pos) / width).cast("bigint")


def running_number(
    df: DataFrame, scope: list[str], group: list[str], pos: str, out: str, width: int = WIDTH
) -> DataFrame:
    """0-based number over ``group`` then ``pos`` inside each ``scope`` (scope + group + pos is unique)."""
    keyed = df.withColumn("_b", bucket(pos, width))
    counts = keyed.groupBy(*scope, *group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*scope).orderBy(*group, "_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*scope, *group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*scope, *group, "_b").orderBy(pos)
    return (
        keyed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*scope, *group, "_b"])
        .withColumn(out, F.col("_before") + F.col("_rn") - 1)
        .drop("_b", "_rn", "_before")
    )


def first_n(df: DataFrame, group: list[str], pos: str, limit: str, max_limit: int, number: str | None = None) -> DataFrame:
    """Rows whose rank by ``pos`` inside ``group`` is at most the ``limit`` column (bounded by ``max_limit``); ``number`` keeps the rank.

    The literal bound lets each task drop all but its first ``max_limit`` rows per group before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(*group).orderBy(pos))
    top = df.withColumn("_rn", rank).filter(F.col("_rn") <= max_limit).filter(F.col("_rn") <= F.col(limit))
    return top.withColumnRenamed("_rn", number) if number else top.drop("_rn")
