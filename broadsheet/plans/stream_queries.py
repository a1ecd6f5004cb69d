"""Streams over events: the table lands in parts, and every part is taken up by a run of its own that starts from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import ledger
from broadsheet.plans.catalog import COPIES_SQL, copies, query, table
from broadsheet.sources import scratch
from broadsheet.streaming import ingest


def landed(rows: DataFrame, parts: int, start: Callable[[DataFrame], object]) -> None:
    """Land the parts (column ``part``) one after another; after each one, run the stream over the landing folder until it is idle."""
    spark = rows.sparkSession
    folder = scratch.folder(spark, "landing")
    schema = rows.drop("part").schema
    for k in range(parts):
        rows.filter(F.col("part") == k).drop("part").write.mode("append").parquet(folder)
        start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()


def _to_files(stream: DataFrame, out: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


# --- T-1: ingest against the ledger ---------------------------------------------------------------------------------
_TYPES = ["click", "error", "purchase", "signup", "view"]


def event_articles(spark: SparkSession, sf: str) -> DataFrame:
    """events as articles of a daily topic page per user and type; ``part`` is the landing."""
    e = table(spark, sf, "events")
    return e.select(
        F.coalesce(F.array_position(F.lit(_TYPES), F.col("event_type")), F.lit(0)).cast("int").alias("source_pos"), F.col("event_id").alias("item_pos"),
        F.col("event_type").alias("title"), F.col("props").alias("content"),
        F.concat(F.lit("https://e.example.org/u/"), F.col("user_id").cast("string"), F.lit("?e="), F.col("event_id").cast("string")).alias("url"),
        ingest.day_of(F.col("ts").cast("timestamp")).alias("published_date"), (F.col("event_id") % 3).cast("int").alias("part"),
    )


_EVENTS_SQL = """a AS (SELECT list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS source_pos, event_id, user_id, CAST(event_id % 3 AS BIGINT) AS run_id,
         md5('https://e.example.org/u/' || user_id || '|' || event_type || '|' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d')) AS content_id FROM events)"""


@query(
    "t1_continuous_ingest",
    f"""WITH {_EVENTS_SQL}, f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY run_id, coalesce(source_pos, 0), event_id) = 1)
    SELECT run_id, CAST(coalesce(source_pos, 0) AS INT) AS source_pos, event_id AS item_pos, content_id FROM f
    WHERE content_id NOT IN (SELECT content_id FROM a WHERE user_id % 5 = 0 AND event_id % 2 = 0)""",
)
def t1(spark, sf):
    rows = event_articles(spark, sf)
    known, out, checkpoint = (scratch.folder(spark, n) for n in ("ledger", "ingested", "checkpoint"))
    earlier = ledger.with_ids(rows.filter(F.split("url", "[/?]")[4].cast("long") % 5 == 0).filter("item_pos % 2 = 0"))
    ledger.append(spark, earlier.groupBy("content_id").agg(F.min("item_pos").alias("ord")), known, 900)
    landed(rows, 3, lambda stream: ingest.ingest(spark, stream, known, out, checkpoint))
    written = spark.read.parquet(out).withColumn("run_id", F.col("run_id").cast("long"))
    # the ledger holds exactly the ids of what was written
    noted = ledger.read(spark, known).filter("run_id <> 900").select("content_id", "run_id")
    return written.join(noted, ["content_id", "run_id"], "full").select("run_id", "source_pos", "item_pos", "content_id")


@query(
    "t1_ingest_documents",
    f"""WITH {COPIES_SQL} SELECT CAST(doc_id % 3 AS BIGINT) AS run_id, source_pos, item_pos, content_id FROM cop
    WHERE content_id NOT IN (SELECT content_id FROM cop WHERE doc_id % 10 = 0) QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY doc_id % 3, source_pos, item_pos) = 1""",
)
def t1_documents(spark, sf):
    """documents with their whole texts, landing in three parts; every tenth is known from an earlier run."""
    rows = copies(spark, sf).withColumn("part", (F.col("doc_id") % 3).cast("int"))
    known, out, checkpoint = (scratch.folder(spark, n) for n in ("ledger", "ingested", "checkpoint"))
    earlier = ledger.with_ids(rows.drop("content").filter("doc_id % 10 = 0"))
    ledger.append(spark, earlier.groupBy("content_id").agg(F.min("item_pos").alias("ord")), known, 900)
    landed(rows.drop("doc_id", "lang"), 3, lambda stream: ingest.ingest(spark, stream, known, out, checkpoint))
    written = spark.read.parquet(out).withColumn("run_id", F.col("run_id").cast("long"))
    return written.select("run_id", "source_pos", "item_pos", "content_id")


# --- T-2: dedup with bounded state ----------------------------------------------------------------------------------
_STARTS = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25"]


def _part(ts):
    return sum(((ts >= F.lit(s).cast("timestamp")).cast("int") for s in _STARTS[1:]), F.lit(0))


_PART_SQL = "(" + " + ".join(f"CAST(ts >= TIMESTAMP '{s}' AS INT)" for s in _STARTS[1:]) + ")"
#: rows that come in the last part, long after their time
_LATE = "event_id % 20 = 0 AND ts < TIMESTAMP '2024-01-05'"


@query(
    "t2_dedup_within",
    f"""WITH RECURSIVE k AS (SELECT DISTINCT user_id || ' ' || event_type AS key, {_PART_SQL} AS part FROM events WHERE NOT ({_LATE})),
    -- a key is forgotten once the part after the next one begins
    o AS (SELECT key, min(part) AS part FROM k GROUP BY key UNION ALL
          SELECT key, (SELECT min(k.part) FROM k WHERE k.key = o.key AND k.part >= o.part + 2) FROM o WHERE part IS NOT NULL)
    SELECT key, part FROM o WHERE part IS NOT NULL""",
)
def t2(spark, sf):
    e = table(spark, sf, "events").withColumn("_t", F.col("ts").cast("timestamp"))
    late = (F.col("event_id") % 20 == 0) & (F.col("_t") < F.lit("2024-01-05").cast("timestamp"))
    own = _part(F.col("_t"))
    rows = e.select(
        F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("key"), F.element_at(F.lit(_STARTS), own + 1).cast("timestamp").alias("seen"),
        F.when(late, 3).otherwise(own).alias("part"),
    )
    out, checkpoint = scratch.folder(spark, "deduped"), scratch.folder(spark, "checkpoint")
    landed(rows, 4, lambda stream: _to_files(ingest.dedup_within(stream, "seen", "key", "4 days"), out, checkpoint))
    return spark.read.parquet(out).select("key", _part(F.col("seen")).cast("int").alias("part"))


# --- T-4: daily counts with late rows -------------------------------------------------------------------------------
@query(
    "t4_daily_counts_stream",
    f"""WITH e AS (SELECT event_type, ts, date_trunc('day', ts + INTERVAL 8 HOUR) AS day, CASE WHEN {_LATE} THEN 3 ELSE {_PART_SQL} END AS part FROM events),
    w AS (SELECT k.part, max(e.ts) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT part FROM e) k LEFT JOIN e ON e.part < k.part GROUP BY k.part),
    l AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM e),
    -- a window is dropped when the mark left by earlier parts has passed its end, and written when the last mark has
    c AS (SELECT e.* FROM e JOIN w USING (part) WHERE w.mark IS NULL OR day + INTERVAL 16 HOUR > w.mark)
    SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM c, l WHERE day + INTERVAL 16 HOUR <= l.mark GROUP BY ALL""",
)
def t4_stream(spark, sf):
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    late = (F.col("event_id") % 20 == 0) & (ts < F.lit("2024-01-05").cast("timestamp"))
    rows = e.select("event_type", ts.alias("ts"), F.when(late, 3).otherwise(_part(ts)).alias("part"))
    out, checkpoint = scratch.folder(spark, "counts"), scratch.folder(spark, "checkpoint")
    landed(rows, 4, lambda stream: _to_files(ingest.daily_counts(stream, "ts", "event_type"), out, checkpoint))
    return spark.read.parquet(out).select("day", "event_type", "n")
