"""Edition tables over documents as articles; a flat source holds one article, as in an edition."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import markup
from broadsheet.operators import edition
from broadsheet.plans.catalog import ARTICLES_SQL, RUNS_SQL, SOURCES_SQL, articles, q, query, runs, sources, suffixed, table
from broadsheet.streaming import ingest

_FLAT = ", ".join(q(t) for t in fv.FLAT_TYPES)

_SQL = f"""WITH {ARTICLES_SQL}, {SOURCES_SQL}, {RUNS_SQL},
ed AS (SELECT art.* FROM art JOIN src USING (source_pos) JOIN (SELECT source_pos, min(item_pos) AS lead FROM art GROUP BY 1) USING (source_pos)
       WHERE type NOT IN ({_FLAT}) OR item_pos = lead),
sec AS (SELECT row_number() OVER (ORDER BY priority DESC, source_pos) - 1 AS section_no, source_pos, type,
               coalesce(nullif(src.title, ''), CASE WHEN type = 'rss' THEN coalesce(nullif(source_title, ''), src) WHEN type = 'web' THEN first_title END, src) AS section_title,
               n_articles, coalesce(sum(n_articles) OVER (ORDER BY priority DESC, source_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_chapter
        FROM run JOIN src USING (source_pos) JOIN (SELECT source_pos, count(*) AS n_articles, arg_min(title, item_pos) AS first_title FROM ed GROUP BY 1) USING (source_pos)
        WHERE success),
chap AS (SELECT doc_id, title, section_no, type, first_chapter + row_number() OVER (PARTITION BY section_no ORDER BY item_pos) - 1 AS chapter_no
         FROM ed JOIN sec USING (source_pos)),
toc AS (SELECT section_no, 1 AS level, CASE WHEN type IN ({_FLAT}) THEN first_chapter END AS chapter_no,
               CASE WHEN type IN ({_FLAT}) THEN 'chapter_' || first_chapter ELSE 'divider_' || section_no END || '.xhtml' AS href,
               CASE WHEN type IN ({_FLAT}) THEN 'chapter_' || first_chapter ELSE 'section_' || section_no END AS uid, section_title AS title FROM sec
        UNION ALL SELECT section_no, 2, chapter_no, 'chapter_' || chapter_no || '.xhtml', 'chapter_' || chapter_no, title FROM chap WHERE type NOT IN ({_FLAT})
        UNION ALL SELECT (SELECT count(*) FROM sec), 1, NULL, 'summary.xhtml', 'summary', {q(fv.SUMMARY_TITLE)})
"""


def _tables(spark, sf):
    s = sources(spark, sf)
    rows = articles(spark, sf).join(s.select("source_pos", "type"), "source_pos")
    lead = rows.groupBy("source_pos").agg(F.min("item_pos").alias("_lead"))
    rows = rows.join(lead, "source_pos").filter(~edition.is_flat() | (F.col("item_pos") == F.col("_lead"))).drop("_lead", "type")
    section_table = edition.sections(rows, runs(spark, sf), s)
    return section_table, edition.number_chapters(rows, section_table)


@query("e2_sections", _SQL + "SELECT section_no, source_pos, type, section_title, n_articles, first_chapter FROM sec")
def sections(spark, sf):
    return _tables(spark, sf)[0]


@query("w4_number_chapters", _SQL + "SELECT doc_id, section_no, chapter_no, md5(title) AS title FROM chap")
def chapters(spark, sf):
    return _tables(spark, sf)[1].select("doc_id", "section_no", "chapter_no", F.md5("title").alias("title"))


@query("e3_toc", _SQL + "SELECT * FROM toc")
def toc(spark, sf):
    return edition.toc(*_tables(spark, sf))


@query(
    "o2_spine",
    _SQL + """SELECT -1 AS section_no, 0 AS kind, NULL::BIGINT AS chapter_no, 'contents.xhtml' AS file_name
    UNION ALL SELECT section_no, 1, NULL, 'divider_' || section_no || '.xhtml' FROM sec
    UNION ALL SELECT section_no, 2, chapter_no, 'chapter_' || chapter_no || '.xhtml' FROM chap
    UNION ALL SELECT (SELECT count(*) FROM sec), 3, NULL, 'summary.xhtml'""",
)
def spine(spark, sf):
    return edition.spine(*_tables(spark, sf))


@query(
    "e4_back_links",
    _SQL + f"""SELECT 'divider_' || section_no || '.xhtml' AS file_name, CASE WHEN type IN ({_FLAT}) THEN 'toc_chapter_' || first_chapter ELSE 'toc_section_' || section_no END AS target FROM sec
    UNION ALL SELECT 'chapter_' || chapter_no || '.xhtml', 'toc_chapter_' || chapter_no FROM chap""",
)
def back_links(spark, sf):
    return edition.back_links(*_tables(spark, sf))


@query("e5_link_check", _SQL + "SELECT 'toc_' || uid AS target, false AS dangling FROM toc")
def link_check(spark, sf):
    section_table, chapter_table = _tables(spark, sf)
    entries = edition.toc(section_table, chapter_table)
    lost = edition.dangling_links(entries, edition.back_links(section_table, chapter_table))
    found = entries.select(F.concat(F.lit("toc_"), "uid").alias("target"), F.lit(False).alias("dangling"))
    return found.unionByName(lost.select("target", F.lit(True).alias("dangling")))


@query("a8_section_index", _SQL + "SELECT section_no, chapter_no, md5(title) AS title, 'chapter_' || chapter_no || '.xhtml' AS file_name FROM chap")
def section_index(spark, sf):
    parts = edition.section_index(_tables(spark, sf)[1]).select("section_no", F.explode("entries").alias("e"))
    return parts.select("section_no", "e.chapter_no", F.md5("e.title").alias("title"), "e.file_name")


@query(
    "x24_emoji_images",
    """SELECT page_id, html || '<img src="images/emoji_1f600.png" alt="😀" class="emoji" style="STYLE">' || page_id AS html FROM pages""".replace("STYLE", fv.EMOJI_IMAGE_STYLE),
)
def emoji_images(spark, sf):
    marked = suffixed(spark, sf, '<span class="emoji">😀</span>{id}')
    return marked.select("page_id", markup.emoji_to_images(F.col("html")).alias("html"))


@query(
    "t4_daily_counts",
    "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def daily_counts(spark, sf):
    events = table(spark, sf, "events")
    return ingest.daily_counts(events, "ts", "event_type")
