"""The token relation: one row per token of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import markup as m


def tokens(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """``keys``, pos (0-based), kind, name, raw.  A narrow explode: rows of a document stay in their partition."""
    parsed = df.select(*keys, F.posexplode(m.parse(F.col(html))).alias("pos", "t"))
    return parsed.select(*keys, "pos", F.col("t.kind").alias("kind"), F.col("t.name").alias("name"), F.col("t.raw").alias("raw"))


def to_html(token_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Documents from their tokens; a document's tokens are as large as the document."""
    return token_rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw"))), lambda t: t["raw"]), "").alias("html")
    )
