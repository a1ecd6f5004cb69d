"""A whole edition of documents and pages, and daily runs from landed payloads to written tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import clean, images, rules
from broadsheet.operators import articles as art
from broadsheet.operators import edition, ledger
from broadsheet.plans import daily
from broadsheet.plans import markup_sql as m
from broadsheet.plans.catalog import _fill, q, query, suffix_sql, table
from broadsheet.plans.scalar_queries import TITLE_SQL, escape_sql
from broadsheet.plans.source_queries import _FEED_SQL, feed_payloads
from broadsheet.sources import scratch

FIRST_PAGE = 1000


# --- U1, E5 to E9: one edition of all documents (as mail) and all pages (as web) ------------------------------------
def _sources_parts(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    d = table(spark, sf, "documents")
    pos = F.substring("source", 4, 10).cast("int")
    mails = d.select(
        pos.alias("source_pos"), F.col("doc_id").alias("item_pos"), F.left(F.split("text", "\n")[0], F.lit(60)).alias("title"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 4 == 3, "mailto:a@b.c").otherwise(F.concat(F.lit("https://d.example.org/?a=1&b="), F.col("doc_id").cast("string"))).alias("url"),
        F.when(F.col("doc_id") % 3 == 0, "A & B").when(F.col("doc_id") % 3 == 1, "").alias("author"), F.when(F.col("doc_id") % 2 == 0, "2024-01-02 03:04").otherwise("").alias("published_date"),
    )
    p = table(spark, sf, "pages")
    pages = p.select(
        (F.col("page_id") + FIRST_PAGE).cast("int").alias("source_pos"), F.lit(0).cast("bigint").alias("item_pos"), F.concat(F.lit("Page <"), F.col("page_id").cast("string"), F.lit(">")).alias("title"),
        F.col("html").alias("content"), "url",
    )
    return mails, pages.withColumn("author", none)


def _articles(spark, sf: str) -> DataFrame:
    return art.union_sources(list(_sources_parts(spark, sf)))


def _config(spark, sf: str) -> DataFrame:
    pos = F.col("source_pos")
    d = table(spark, sf, "documents").select(F.substring("source", 4, 10).cast("int").alias("source_pos"), F.col("source").alias("src")).distinct()
    p = table(spark, sf, "pages").select((F.col("page_id") + FIRST_PAGE).cast("int").alias("source_pos"), F.col("url").alias("src"))
    title = F.when(pos % 3 == 0, F.concat(F.lit("Section & "), pos.cast("string")))
    return d.withColumn("type", F.lit("mail")).unionByName(p.withColumn("type", F.lit("web"))).select("source_pos", "type", "src", title.alias("title"), (pos * 7 % 5).alias("priority"))


def _runs(spark, sf: str) -> DataFrame:
    pos = F.col("source_pos")
    failed = pos % 7 == 3
    return _config(spark, sf).select(
        "source_pos", (~failed).alias("success"), F.when(failed, F.when(pos % 2 == 1, F.concat(F.lit("timeout <"), pos.cast("string"), F.lit(">"))).otherwise("")).alias("error"), F.lit("").alias("source_title")
    )


_EDITION_SQL = f"""WITH art AS (
    SELECT CAST(substr(source, 4) AS INT) AS source_pos, doc_id AS item_pos, left(split_part(text, chr(10), 1), 60) AS title, text AS content,
        CASE WHEN doc_id % 4 = 3 THEN 'mailto:a@b.c' ELSE 'https://d.example.org/?a=1&b=' || doc_id END AS url, CASE doc_id % 3 WHEN 0 THEN 'A & B' ELSE '' END AS author,
        CASE WHEN doc_id % 2 = 0 THEN '2024-01-02 03:04' ELSE '' END AS published_date FROM documents
    UNION ALL SELECT CAST(page_id + {FIRST_PAGE} AS INT), 0, 'Page <' || page_id || '>', html, url, '', '' FROM pages),
cfg AS (SELECT *, CASE WHEN source_pos % 3 = 0 THEN 'Section & ' || source_pos END AS title, source_pos * 7 % 5 AS priority, source_pos % 7 <> 3 AS success FROM
    (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS source_pos, source AS src, 'mail' AS type FROM documents UNION ALL SELECT CAST(page_id + {FIRST_PAGE} AS INT), url, 'web' FROM pages)),
cnt AS (SELECT source_pos, count(*) AS n, arg_min(title, item_pos) AS first_title FROM art GROUP BY source_pos),
sec AS (SELECT row_number() OVER w - 1 AS section_no, source_pos, type, n, coalesce(title, CASE WHEN type = 'web' THEN first_title END, src) AS section_title,
    CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_chapter FROM cfg JOIN cnt USING (source_pos) WHERE success WINDOW w AS (ORDER BY priority DESC, source_pos)),
chap AS (SELECT art.*, section_no, type, first_chapter + row_number() OVER (PARTITION BY section_no ORDER BY item_pos) - 1 AS chapter_no FROM art JOIN sec USING (source_pos))
"""


def _tables(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _articles(spark, sf)
    section_table = edition.sections(rows, _runs(spark, sf), _config(spark, sf))
    return section_table, edition.number_chapters(rows, section_table)


@query("u1_union_sources", _EDITION_SQL + "SELECT source_pos, item_pos, title, md5(content) AS content, url FROM art")
def u1(spark, sf):
    return _articles(spark, sf).select("source_pos", "item_pos", "title", F.md5("content").alias("content"), "url")


def _page_sql(title: str, body: str) -> str:
    head = '<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="zh" xml:lang="zh"><head><title>'
    middle = '</title><link rel="stylesheet" type="text/css" href="style/default.css"/></head><body><h1>'
    return f"{q(head)} || {title} || {q(middle)} || {title} || '</h1>' || {body} || '</body></html>'"


def _back_sql(target: str) -> str:
    return f"""'<p class="toc-link"><a href="contents.xhtml#' || {target} || '">{fv.BACK_TO_CONTENTS}</a></p>'"""


_CHAPTER = _page_sql(
    escape_sql("title"),
    _back_sql("'toc_chapter_' || chapter_no") + f""" || CASE WHEN author <> '' THEN '<p class=''author''>作者: ' || {escape_sql('author')} || '</p>' ELSE '' END
    || CASE WHEN published_date <> '' THEN '<p class=''date''>日期: ' || published_date || '</p>' ELSE '' END || '<div class=''content''>' || content || '</div>'
    || CASE WHEN starts_with(url, 'http') THEN '<p class=''link''>原文链接: <a href=''' || {escape_sql('url')} || '''>' || {escape_sql('url')} || '</a></p>' ELSE '' END""",
)


@query("e7_render_chapters", _EDITION_SQL + f"SELECT section_no, chapter_no, title, url, 'chapter_' || chapter_no || '.xhtml' AS file_name, md5({_CHAPTER}) AS html FROM chap")
def e7(spark, sf):
    return edition.render_chapters(_tables(spark, sf)[1]).withColumn("html", F.md5("html"))


_PART = edition.PART_ENTRIES
_TARGET = "CASE WHEN type = 'web' THEN 'toc_chapter_' || first_chapter ELSE 'toc_section_' || section_no END"


@query(
    "e6_dividers",
    _EDITION_SQL + f"""SELECT section_no, CAST(-1 AS BIGINT) AS part_no, md5('<h1>' || {escape_sql('section_title')} || '</h1>' || {_back_sql(_TARGET)} || '<div id="toc"><ol>') AS html FROM sec
    UNION ALL SELECT section_no, chapter_no // {_PART}, md5(string_agg('<li><a class="article-link" href="chapter_' || chapter_no || '.xhtml">' || {escape_sql('title')} || '</a></li>', '' ORDER BY chapter_no)) FROM chap GROUP BY ALL
    UNION ALL SELECT section_no, 9223372036854775807, md5('</ol></div>') FROM sec""",
)
def e6(spark, sf):
    return edition.dividers(*_tables(spark, sf)).withColumn("html", F.md5("html"))


_ENTRY = "'<li id=\"toc_' || uid || '\"><a class=\"' || CASE WHEN level = 1 THEN 'section-link' ELSE 'article-link' END || '\" href=\"' || href || '\">' || " + escape_sql("title") + " || '</a>'"


@query(
    "e9_navigation",
    _EDITION_SQL + f""", toc AS (
        SELECT section_no, 1 AS level, CASE WHEN type = 'web' THEN first_chapter END AS chapter_no, CASE WHEN type = 'web' THEN 'chapter_' || first_chapter ELSE 'divider_' || section_no END || '.xhtml' AS href,
            CASE WHEN type = 'web' THEN 'chapter_' || first_chapter ELSE 'section_' || section_no END AS uid, section_title AS title, CASE WHEN type = 'web' THEN '</li>' ELSE '<ol>' END AS tail FROM sec
        UNION ALL SELECT section_no, 2, chapter_no, 'chapter_' || chapter_no || '.xhtml', 'chapter_' || chapter_no, title, '</li>' FROM chap WHERE type <> 'web'
        UNION ALL SELECT (SELECT count(*) FROM sec), 1, NULL, 'summary.xhtml', 'summary', {q(fv.SUMMARY_TITLE)}, '</li>')
    SELECT section_no, level, chapter_no, md5({_ENTRY} || tail) AS html FROM toc UNION ALL SELECT section_no, 3, NULL, md5('</ol></li>') FROM sec WHERE type <> 'web'""",
)
def e9(spark, sf):
    section_table, chapters = _tables(spark, sf)
    lines = edition.render_nav(edition.toc(section_table, chapters), section_table)
    return lines.select(F.col("section_no").cast("bigint").alias("section_no"), F.col("level").cast("int").alias("level"), "chapter_no", F.md5("html").alias("html"))


def _stat(label: str, value: str) -> str:
    return f"""'<div class="stat-item"><span class="stat-label">{label}：</span>' || {value} || '</div>'"""


@query(
    "e8_summary",
    _EDITION_SQL + f""", err AS (SELECT *, CASE WHEN success THEN NULL WHEN source_pos % 2 = 1 THEN 'timeout <' || source_pos || '>' ELSE '' END AS error FROM cfg)
    SELECT 1 AS block, -1 AS source_pos, {_stat('数据源总数', 'count(*)')} || {_stat('成功抓取', 'count(*) FILTER (success)')} || {_stat('抓取失败', 'count(*) FILTER (NOT success)')} || {_stat('新增文章', '(SELECT count(*) FROM art)')} AS html FROM cfg
    UNION ALL SELECT 2, source_pos, '<li class="source-item"><span class="stat-label">[' || upper(type) || '] ' || {escape_sql('coalesce(title, src)')} || '</span>：'
        || CASE WHEN success THEN '<span class="tag-success">成功</span>，新增 ' || coalesce(n, 0) || ' 篇文章</li>' ELSE '<span class="tag-failed">失败</span> (' || {escape_sql(f"coalesce(nullif(error, ''), {q(fv.UNKNOWN_ERROR)})")} || ')</li>' END
        FROM err LEFT JOIN cnt USING (source_pos)
    UNION ALL SELECT 3, source_pos, '<li>' || {escape_sql("'[' || type || '] ' || src || ': ' || error")} || '</li>' FROM err WHERE NOT success""",
)
def e8(spark, sf):
    return edition.render_summary(_runs(spark, sf), _articles(spark, sf), _config(spark, sf))


@query(
    "e5_dangling_links",
    _EDITION_SQL + "SELECT 'chapter_' || chapter_no || '.xhtml' AS file_name, 'toc_chapter_' || chapter_no AS target FROM chap WHERE type <> 'web' AND chapter_no % 7 = 3",
)
def e5(spark, sf):
    """Links of an edition whose contents lack every seventh chapter of the sections with dividers."""
    section_table, chapters = _tables(spark, sf)
    entries = edition.toc(section_table, chapters).filter((F.col("level") == 1) | (F.col("chapter_no") % 7 != 3))
    return edition.dangling_links(entries, edition.back_links(section_table, chapters)).select("file_name", "target")


# --- E10, S15, P2: daily runs ---------------------------------------------------------------------------------------
_RUN_SQL = f"""WITH art AS ({_FEED_SQL}),
ids AS (SELECT *, md5(regexp_replace(url, '\\?.*$', '') || '|' || title || CASE WHEN published_date <> '' THEN '|' || published_date ELSE '' END) AS content_id FROM art),
one AS (SELECT *, 1 AS run FROM ids WHERE source_pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY source_pos, item_pos) = 1),
two AS (SELECT *, 2 AS run FROM ids WHERE content_id NOT IN (SELECT content_id FROM one) QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY source_pos, item_pos) = 1),
new AS (SELECT * FROM one UNION ALL SELECT * FROM two),
sec AS (SELECT run, source_pos, n, row_number() OVER w - 1 AS section_no, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_chapter
        FROM (SELECT run, source_pos, count(*) AS n FROM new GROUP BY ALL) WINDOW w AS (PARTITION BY run ORDER BY source_pos % 3 DESC, source_pos)),
chap AS (SELECT new.*, section_no, first_chapter + row_number() OVER (PARTITION BY run, section_no ORDER BY item_pos) - 1 AS chapter_no FROM new JOIN sec USING (run, source_pos))
"""


@query(
    "e10_daily_runs",
    _RUN_SQL + """SELECT '2024-05-0' || (5 + run) AS edition_date, section_no, chapter_no, title, url, content_id FROM chap""",
)
def e10(spark, sf):
    """Half of the feeds on the first day, all on the second, the second day twice; chapters of both editions with their ledger entries."""
    config_path, known, out, work, landed = (scratch.folder(spark, n) for n in ("config", "ledger", "editions", "work", "landed"))
    feed_payloads(spark, sf).write.parquet(landed)
    payloads = spark.read.parquet(landed)
    entry = F.struct(
        F.lit("rss").alias("type"), F.concat(F.lit("https://f.example.org/feed/"), F.col("source_pos").cast("string")).alias("src"), (F.col("source_pos") % 3).alias("priority"),
        F.when(F.col("source_pos") % 7 == 3, "The, zz").alias("delete"), F.when(F.col("source_pos") % 3 == 1, F.create_map(F.lit("limit"), F.lit("5"))).alias("metadata"),
    )
    # the configuration is one document that names every source
    body = payloads.select("source_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_pos", F.to_json(entry).alias("e")))), lambda x: x["e"]), ",").alias("body"))
    body.select(F.concat(F.lit('{"title": {"text": "Daily"}, "limit": 15, "body": ['), "body", F.lit("]}")).alias("value")).coalesce(1).write.text(config_path)
    half = payloads.filter(F.col("source_pos") % 2 == 0)
    for run_id, day, some in ((1, 6, half), (2, 7, payloads), (2, 7, payloads)):
        as_of = dt.datetime(2024, 5, day, 4, tzinfo=dt.timezone.utc)
        daily.run(spark, config_path, lambda kind, rows=some: rows if kind == "rss" else None, known, out, work, as_of, run_id)
    written = spark.read.option("basePath", f"{out}/chapters").parquet(f"{out}/chapters").withColumn("edition_date", F.col("edition_date").cast("string"))
    new = spark.read.option("basePath", work).parquet(*[f"{work}/run_id={r}/new" for r in (1, 2)]).select("url", "title", "content_id", F.col("run_id").cast("long").alias("run_id"))
    noted = ledger.read(spark, known).select("content_id", "run_id")
    named = new.join(noted, ["content_id", "run_id"]).withColumn("edition_date", F.concat(F.lit("2024-05-0"), (F.col("run_id") + 5).cast("string")))
    return written.select("edition_date", "section_no", "chapter_no", "title", "url").join(named.select("edition_date", "url", "title", "content_id"), ["edition_date", "url", "title"])


# --- weak spots: rules in sequence, lead image, titles --------------------------------------------------------------
_MARKS = '<p>pre <b>Start {id}</b> post <br> and <i>more</i></p><p>mid</p><p>then <u>End {id} of it</u> rest</p>'


def _marked(spark, sf: str) -> DataFrame:
    return table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("</h1>"), F.concat(F.lit("</h1>"), _fill(_MARKS))))


def _sequence_sql() -> str:
    s = m.Script()
    s.add("src", f"SELECT page_id, url, replace(html, '</h1>', '</h1>' || {suffix_sql(_MARKS)}) AS html FROM pages")
    cut = m.cut(s, "c", "src", "'Start ' || page_id", True)
    s.add("gone", f"SELECT page_id, url, replace(html, '<br>', '') AS html FROM {cut}")
    cut = m.cut(s, "d", "gone", "'End ' || page_id", False)
    return s.query(f"SELECT page_id, html AS cut FROM {cut}")


@query("x9_rule_sequence", _sequence_sql())
def x9(spark, sf):
    rule = lambda t, v: F.struct(F.lit(t).alias("type"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    pid = F.col("page_id").cast("string")
    some = F.array(
        rule("tail", "x"), rule("start", F.concat(F.lit("Start "), pid)), rule("exact", ""), rule("exact", "<br>"), rule("start", "no such text here"),
        rule(" end ", F.concat(F.lit("End "), pid)), rule("end", ""),
    )
    return _marked(spark, sf).select("page_id", rules.apply_rules(F.col("html"), some).alias("cut"))


@query(
    "x5_lead_image_shown",
    f"""SELECT page_id, CASE WHEN page_id % 4 IN (0, 1, 3) THEN html ELSE regexp_replace(html, '<body>', '<body><p><img src="https://c.example.net/z' || page_id || '.png" alt="Lead Image"></p>') END AS led
    FROM (SELECT page_id, replace(html, '</h1>', '</h1>' || {suffix_sql('<img src="/a{id}.png"><img data-src="https://c.example.net/b{id}.png?w=1">')}) AS html FROM pages)""",
)
def x5(spark, sf):
    """The lead image holds an image's address, is held in one, is shown nowhere, or there is none."""
    p = table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("</h1>"), F.concat(F.lit("</h1>"), _fill('<img src="/a{id}.png"><img data-src="https://c.example.net/b{id}.png?w=1">'))))
    name = lambda x: F.array(F.concat(F.lit(f"https://c.example.net/{x}"), F.col("page_id").cast("string"), F.lit(".png")))
    n = F.col("page_id") % 4
    return p.select("page_id", images.insert_lead_image(F.col("html"), F.when(n == 0, name("a")).when(n == 1, name("b")).when(n == 2, name("z"))).alias("led"))


@query(
    "f15_title_fallbacks",
    f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' og ' || page_id || ' ' WHEN 1 THEN 'configured' WHEN 2 THEN url ELSE {TITLE_SQL} END AS title FROM pages",
)
def f15(spark, sf):
    """og:title, the configured title and the address, for pages without a title and a heading."""
    p = table(spark, sf, "pages")
    n = F.col("page_id") % 4
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<title>.*</title>", ""), r"(?s)<h1>.*</h1>", "")
    og = F.concat(F.lit('<meta property="og:title" content=" og '), F.col("page_id").cast("string"), F.lit(' ">'))
    html = F.when(n == 0, F.concat(og, bare)).when(n < 3, bare).otherwise(F.col("html"))
    return p.select("page_id", clean.page_title(html, F.when(n == 1, "configured").when(n == 3, "not used"), F.col("url")).alias("title"))


# --- S1, P2, G1 to G3: configuration, guard, adapters ---------------------------------------------------------------
@query(
    "s1_read_config",
    f"""SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INT) AS source_pos, 'web' AS type, c_name AS src, CASE c_custkey % 3 WHEN 1 THEN c_nationkey ELSE 0 END AS priority,
        CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE 'Y' END AS keep_link, 'N' AS full_text, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS n_rules, {fv.DEFAULT_LIMIT} AS run_limit FROM customer""",
)
def s1(spark, sf):
    """customer as the entries of one configuration document, in key order; priorities are numbers, '' or absent."""
    from broadsheet.sources import config

    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    text = lambda name, value: F.concat(F.lit(f', "{name}": '), value)
    entry = F.concat(
        F.lit('{"type": "web", "src": '), F.to_json(F.struct(F.col("c_name").alias("x"))).substr(F.lit(6), F.length("c_name") + 2),
        F.when(key % 3 == 1, text("priority", F.col("c_nationkey").cast("string"))).when(key % 3 == 2, F.lit(', "priority": ""')).otherwise(""),
        F.when(key % 2 == 0, F.lit(', "keep_link": "N"')).otherwise(""),
        F.when(key % 4 == 0, F.lit(', "exclude": [{"type": "exact", "value": "a"}, {"type": "end", "value": "b"}]')).otherwise(""), F.lit("}"),
    )
    path = scratch.folder(spark, "config")
    # the configuration is one document that names every source
    body = c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))), lambda x: x["e"]), ",\n").alias("body"))
    body.select(F.concat(F.lit('{"title": {"text": "T"}, "body": ['), "body", F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    rows = config.read_config(spark, path)
    return rows.select("source_pos", "type", "src", "priority", "keep_link", "full_text", F.coalesce(F.array_size("exclude"), F.lit(0)).alias("n_rules"), F.lit(config.read_limit(spark, path)).alias("run_limit"))


@query(
    "p2_new_content",
    """SELECT unnest(['all', 'of failed sources', 'none']) AS articles, unnest([count(*) FILTER (CAST(substr(source, 4) AS INT) % 3 <> 0) > 0,
        count(*) FILTER (CAST(substr(source, 4) AS INT) % 3 = 0 AND CAST(substr(source, 4) AS INT) % 3 <> 0) > 0, false]) AS any_new FROM documents""",
)
def p2(spark, sf):
    """Whether an edition is worth it: for all documents, for those of failed sources, and for none."""
    d = table(spark, sf, "documents").withColumn("source_pos", F.substring("source", 4, 10).cast("int"))
    runs = d.select("source_pos").distinct().withColumn("success", F.col("source_pos") % 3 != 0)
    cases = {"all": d, "of failed sources": d.filter("source_pos % 3 = 0"), "none": d.filter("source_pos IS NULL")}
    return spark.createDataFrame([(name, edition.has_new_content(rows, runs)) for name, rows in cases.items()], "articles string, any_new boolean")


@query(
    "g3_isolated_sources",
    """WITH f AS (SELECT DISTINCT CAST(doc_id // 20 AS INT) AS feed FROM documents), m AS (SELECT feed, feed % 3 AS kind FROM f)
    SELECT feed AS source_pos, CASE kind WHEN 0 THEN feed % 5 < 4 WHEN 1 THEN feed % 6 <> 5 ELSE false END AS success,
        CASE kind WHEN 0 THEN CASE WHEN feed % 5 = 4 THEN 'Failed to parse RSS feed: ' || CASE WHEN feed % 2 = 0 THEN 'No entries found' ELSE 'not well-formed' END END
            WHEN 1 THEN CASE WHEN feed % 6 = 5 THEN 'API error: ' || CASE WHEN feed % 12 = 11 THEN 'Unknown API error' ELSE 'bad key ' || feed END END ELSE 'No payload landed' END AS error FROM m""",
)
def g3(spark, sf):
    """Feeds and mailboxes side by side, some of them broken, and sources that landed nothing: every source has a run, none stops the others."""
    from broadsheet.plans.source_queries import _configured, mail_payloads

    feeds_landed, mails_landed = feed_payloads(spark, sf).filter(F.col("source_pos") % 3 == 0), mail_payloads(spark, sf).filter(F.col("source_pos") % 3 == 1)
    kind = F.element_at(F.lit(["rss", "mail", "web"]), (F.col("source_pos") % 3 + 1).cast("int"))
    sources = _configured(feed_payloads(spark, sf), "source_pos").withColumn("type", kind).withColumn("src", F.lit("s"))
    landed = {"rss": feeds_landed, "mail": mails_landed}
    _, runs = daily.collect_sources(spark, sources, landed.get, 15, dt.datetime(2024, 5, 6))
    return runs.select("source_pos", "success", "error")
