"""What the operators share: reading a table, staging between jobs, the registry of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.scratch import shared

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only in a local session without one."""
    return shared(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends here and a lost executor costs one task."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that run inside go as soon as their job is done, instead of when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(column: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def bucketed(df: DataFrame, name: str, n: int, *columns: str) -> DataFrame:
    """A staged table in ``n`` buckets: later joins and groups on the columns read it without a shuffle."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *columns).option("path", f"{scratch(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)
