"""Registry of runnable queries over the given tables, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the given tables in the roles of the data model ----------------------------------------------------------------
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as feed items: one source per ``source``, items in doc_id order."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.substring("source", 4, 10).cast("int").alias("source_pos"),
        F.col("doc_id").alias("item_pos"),
        F.left(F.split("text", "\n")[0], F.lit(80)).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string"), F.lit("?x=1")).alias("url"),
        F.lit("").alias("author"),
        F.lit(None).cast("string").alias("published_date"),
        F.col("doc_id"),
        F.col("lang"),
    )


ARTICLES_SQL = """art AS (
  SELECT CAST(substr(source, 4) AS INT) AS source_pos, doc_id AS item_pos, left(split_part(text, chr(10), 1), 80) AS title,
         text AS content, 'https://' || source || '.example.org/' || doc_id || '?x=1' AS url, doc_id, lang
  FROM documents)"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose address is their language's, so that equal titles are the same content."""
    return articles(spark, sf_dir).withColumn("url", F.concat(F.lit("https://example.org/"), "lang", F.lit("/?d="), F.col("doc_id").cast("string")))


COPIES_SQL = ARTICLES_SQL + """, cop AS (
  SELECT source_pos, item_pos, title, doc_id,
         md5('https://example.org/' || lang || CASE WHEN title <> '' THEN '|' || title ELSE '' END) AS content_id
  FROM art)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration rows derived from the distinct sources of documents."""
    pos = F.col("source_pos")
    base = table(spark, sf_dir, "documents").select(F.substring("source", 4, 10).cast("int").alias("source_pos"), F.col("source").alias("src")).distinct()
    rule = lambda t, v: F.struct(F.lit(t).alias("type"), F.lit(v).alias("value"))
    return base.select(
        "source_pos",
        F.element_at(F.array(*[F.lit(t) for t in ("rss", "web", "mail", "trending")]), (pos % 4) + 1).alias("type"),
        "src",
        (pos * 7 % 5).alias("priority"),
        F.when(pos % 3 == 0, F.concat(F.lit("Section & "), pos.cast("string"))).alias("title"),
        F.when(pos % 2 == 0, "Y").otherwise("N").alias("keep_link"),
        F.when(pos % 3 == 0, "Y").otherwise("N").alias("full_text"),
        F.when(pos % 5 == 0, F.array(rule("exact", "the "), rule("start", "."), rule("end", ". "), rule("exact", ""), rule("tail", "x"))).alias("exclude"),
        F.when(pos % 5 == 0, " Th, Und").when(pos % 5 == 1, "").alias("delete"),
        F.when(pos % 4 == 1, F.create_map(F.lit("limit"), (pos + 3).cast("string"))).alias("metadata"),
    )


SOURCES_SQL = """src AS (
  SELECT source_pos, src, (['rss', 'web', 'mail', 'trending'])[source_pos % 4 + 1] AS type, source_pos * 7 % 5 AS priority,
         CASE WHEN source_pos % 3 = 0 THEN 'Section & ' || source_pos END AS title,
         CASE WHEN source_pos % 4 = 1 THEN source_pos + 3 ELSE 15 END AS lim,
         CASE WHEN source_pos % 5 = 0 THEN ' Th, Und' WHEN source_pos % 5 = 1 THEN '' END AS del
  FROM (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS source_pos, source AS src FROM documents))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("source_pos")
    return sources(spark, sf_dir).select(
        "source_pos",
        (pos % 7 != 3).alias("success"),
        F.when(pos % 7 == 3, F.when(pos % 2 == 1, F.concat(F.lit("timeout <"), pos.cast("string"), F.lit(">"))).otherwise("")).alias("error"),
        F.when((pos % 4 == 0) & (pos % 8 == 0), F.concat(F.lit("Feed "), pos.cast("string"))).otherwise("").alias("source_title"),
    )


RUNS_SQL = """run AS (
  SELECT source_pos, source_pos % 7 <> 3 AS success,
         CASE WHEN source_pos % 7 = 3 THEN CASE WHEN source_pos % 2 = 1 THEN 'timeout <' || source_pos || '>' ELSE '' END END AS error,
         CASE WHEN source_pos % 8 = 0 THEN 'Feed ' || source_pos ELSE '' END AS source_title
  FROM src)"""


def even_ledger(rows: DataFrame) -> DataFrame:
    """Ids of the even documents as an earlier run's ledger."""
    return rows.filter(F.col("doc_id") % 2 == 0).select(
        "content_id", F.lit(1).cast("bigint").alias("run_id"), F.col("doc_id").alias("ord")
    )


# --- markup suffixes for pages --------------------------------------------------------------------------------------
def suffixed(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """pages with a suffix built from page_id appended to html: {id} and {m} (page_id modulo 64)."""
    p = table(spark, sf_dir, "pages")
    return p.withColumn("html", F.concat("html", _fill(template)))


def _fill(template: str) -> Column:
    text = F.replace(F.lit(template), F.lit("{id}"), F.col("page_id").cast("string"))
    return F.replace(text, F.lit("{m}"), (F.col("page_id") % 64).cast("string"))


def q(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def suffix_sql(template: str) -> str:
    return f"replace(replace({q(template)}, '{{id}}', CAST(page_id AS VARCHAR)), '{{m}}', CAST(page_id % 64 AS VARCHAR))"
