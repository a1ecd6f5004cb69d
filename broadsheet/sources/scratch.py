"""Folders for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The shared place named by spark.checkpoint.dir; without one only a local session, as in tests, gets a place of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="broadsheet-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared place."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
