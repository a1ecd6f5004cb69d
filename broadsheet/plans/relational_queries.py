"""Ledger, filter and statistics operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.operators import filters, ledger, stats
from broadsheet.plans.catalog import ARTICLES_SQL, COPIES_SQL, RUNS_SQL, SOURCES_SQL, articles, copies, even_ledger, query, runs, sources, table

_FIRST = """, fst AS (SELECT content_id, min((source_pos, item_pos)) AS k FROM cop GROUP BY content_id)"""
_SEEN = """, led AS (SELECT content_id FROM cop WHERE doc_id % 2 = 0)"""


def _keyed(spark, sf):
    return ledger.with_ids(copies(spark, sf))


@query(
    "w1_first_occurrence",
    f"WITH {COPIES_SQL}{_FIRST} SELECT c.doc_id, c.content_id, c.title FROM cop c JOIN fst f ON c.content_id = f.content_id AND (c.source_pos, c.item_pos) = f.k",
)
def w1(spark, sf):
    return ledger.first_occurrence(_keyed(spark, sf)).select("doc_id", "content_id", "title")


_NEW_SQL = (
    f"WITH {COPIES_SQL}{_FIRST}{_SEEN} SELECT c.doc_id, c.content_id, c.title FROM cop c JOIN fst f ON c.content_id = f.content_id "
    "AND (c.source_pos, c.item_pos) = f.k WHERE c.content_id NOT IN (SELECT content_id FROM led)"
)


@query("j1_new_articles", _NEW_SQL)
def new_articles(spark, sf):
    rows = _keyed(spark, sf)
    return ledger.new_articles(rows, even_ledger(rows)).select("doc_id", "content_id", "title")


@query("j1_not_seen", f"WITH {COPIES_SQL}{_SEEN} SELECT doc_id, content_id FROM cop WHERE content_id NOT IN (SELECT content_id FROM led)")
def j1(spark, sf):
    rows = _keyed(spark, sf)
    return ledger.new_only(rows, even_ledger(rows)).select("doc_id", "content_id")


@query("j2_seen", f"WITH {COPIES_SQL}{_SEEN} SELECT doc_id, content_id FROM cop WHERE content_id IN (SELECT content_id FROM led)")
def j2(spark, sf):
    rows = _keyed(spark, sf)
    return ledger.seen_only(rows, even_ledger(rows)).select("doc_id", "content_id")


@query("u3_union_new", f"WITH {COPIES_SQL}{_SEEN} SELECT content_id FROM led UNION ALL SELECT content_id FROM (SELECT DISTINCT content_id FROM cop) WHERE content_id NOT IN (SELECT content_id FROM led)")
def u3(spark, sf):
    rows = _keyed(spark, sf)
    return ledger.union_new(even_ledger(rows), rows)


@query("w2_limit_per_source", f"WITH {ARTICLES_SQL}, {SOURCES_SQL} SELECT doc_id, source_pos FROM (SELECT doc_id, art.source_pos, lim, row_number() OVER (PARTITION BY art.source_pos ORDER BY item_pos) AS rn FROM art JOIN src USING (source_pos)) WHERE rn <= lim")
def w2(spark, sf):
    return filters.limit_per_source(articles(spark, sf), sources(spark, sf)).select("doc_id", "source_pos")


_HIT = "coalesce(del, '') <> '' AND len(list_filter(string_split(del, ','), lambda k: contains(art.title, trim(k)))) > 0"


@query("p1_drop_titles", f"WITH {ARTICLES_SQL}, {SOURCES_SQL} SELECT doc_id, art.title FROM art JOIN src USING (source_pos) WHERE NOT ({_HIT})")
def p1(spark, sf):
    return filters.drop_titles(articles(spark, sf), sources(spark, sf)).select("doc_id", "title")


@query("a1_run_summary", f"WITH {ARTICLES_SQL}, {SOURCES_SQL}, {RUNS_SQL} SELECT count(*) AS sources, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, (SELECT count(*) FROM art) AS articles FROM run")
def a1(spark, sf):
    return stats.run_summary(runs(spark, sf), articles(spark, sf))


@query(
    "a2_source_summary",
    f"""WITH {ARTICLES_SQL}, {SOURCES_SQL}, {RUNS_SQL}, n AS (SELECT source_pos, count(*) AS n FROM art GROUP BY 1)
    SELECT source_pos, upper(type) AS type, coalesce(nullif(source_title, ''), nullif(title, ''), src) AS name, success,
           CASE WHEN success THEN coalesce(n, 0) END AS new_articles,
           CASE WHEN NOT success THEN coalesce(nullif(error, ''), '{fv.UNKNOWN_ERROR}') END AS error
    FROM run JOIN src USING (source_pos) LEFT JOIN n USING (source_pos)""",
)
def a2(spark, sf):
    return stats.source_summary(runs(spark, sf), articles(spark, sf), sources(spark, sf))


@query(
    "a3_dedup_ratio",
    f"""WITH {COPIES_SQL}{_FIRST}, o AS (SELECT source_pos, count(*) AS original FROM cop GROUP BY 1),
    k AS (SELECT source_pos, count(*) AS kept FROM cop c JOIN fst f ON c.content_id = f.content_id AND (c.source_pos, c.item_pos) = f.k GROUP BY 1)
    SELECT source_pos, coalesce(kept, 0) AS kept, original FROM o LEFT JOIN k USING (source_pos)""",
)
def a3(spark, sf):
    rows = _keyed(spark, sf)
    return stats.dedup_ratio(rows, ledger.first_occurrence(rows))


@query("a4_ledger_stats", f"WITH {COPIES_SQL} SELECT count(DISTINCT content_id) AS total_fetched, count(*) AS new_fetched FROM cop WHERE doc_id % 2 = 0")
def a4(spark, sf):
    return ledger.stats(even_ledger(_keyed(spark, sf)), 1)


@query("a5_error_log", f"WITH {SOURCES_SQL}, {RUNS_SQL} SELECT source_pos, '[' || type || '] ' || src || ': ' || coalesce(error, 'None') AS line FROM run JOIN src USING (source_pos) WHERE NOT success")
def a5(spark, sf):
    return stats.error_log(runs(spark, sf), sources(spark, sf))


@query(
    "w5_compact_ledger",
    "SELECT l_orderkey * 8 + l_linenumber AS ord, CAST(l_suppkey AS BIGINT) AS run_id FROM lineitem "
    "QUALIFY row_number() OVER (ORDER BY l_suppkey DESC, l_orderkey * 8 + l_linenumber DESC) <= 20000",
)
def w5(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("content_id"), F.col("l_suppkey").cast("bigint").alias("run_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("ord"),
    )
    return ledger.compact(rows, 20_000).select("ord", "run_id")
