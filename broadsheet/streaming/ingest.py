"""Structured Streaming: continuous ingest against the ledger, bounded-state dedup, daily keys and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet import fixed_values as fv
from broadsheet.operators import ledger

ZONE_SHIFT_HOURS = 8


def day_of(ts: Column) -> Column:
    """Edition day of an instant, independent of the session zone."""
    utc = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.unix_seconds(ts).cast("decimal(18,6)"))
    return F.left(F.convert_timezone(F.lit("UTC"), F.lit(fv.EDITION_ZONE), utc).cast("string"), F.lit(10))


def daily_key(df: DataFrame, url: str, title: str, ts: str) -> DataFrame:
    """Rows with a content id that changes every edition day, so the same topic enters once a day."""
    return df.withColumn("content_id", ledger.content_id(F.col(url), F.col(title), day_of(F.col(ts))))


def ingest(
    spark: SparkSession, articles: DataFrame, ledger_path: str, out_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append each micro-batch's new articles to ``out_path`` and their ids to the ledger.

    Batch id is run id.  The ledger is read without the batch's own partition and both sinks overwrite the batch's
    partition, so a replayed batch writes the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = ledger.read(session, ledger_path).filter(F.col("run_id") != batch_id)
        new = ledger.new_articles(ledger.with_ids(batch), known)
        folder = f"{out_path}/run_id={batch_id}"
        new.write.mode("overwrite").parquet(folder)
        # ids come from the written rows, so articles and ledger cannot differ; a batch without news is an empty folder
        written = session.read.schema(new.schema).parquet(folder)
        order = F.col("source_pos").cast("bigint") * 2**32 + F.col("item_pos")
        ledger.append(session, written.select("content_id", order.alias("ord")), ledger_path, batch_id)

    stream = articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def dedup_within(df: DataFrame, ts: str, key: str, horizon: str = "7 days") -> DataFrame:
    """Drop repeats of a key seen within the horizon; state older than that is forgotten."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def daily_counts(df: DataFrame, ts: str, source: str, lateness: str = "1 day") -> DataFrame:
    """Rows per source and edition day; rows later than ``lateness`` are dropped by a stream."""
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    window = F.window("_ts", "1 day", startTime=f"{24 - ZONE_SHIFT_HOURS} hours")
    return timed.groupBy(window.alias("w"), source).agg(F.count(F.lit(1)).alias("n")).select(
        day_of(F.col("w.start")).alias("day"), source, "n"
    )
