"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import clean, dates, images, textops, urls
from broadsheet.operators import ledger
from broadsheet.plans.catalog import ARTICLES_SQL, articles, q, query, table
from broadsheet.streaming import ingest

_SP = fv.SPACE_CLASS
_PARTS = q(fv.URL_PARTS)


def norm_sql(url: str) -> str:
    scheme = f"lower(regexp_extract({url}, {_PARTS}, 1))"
    path = f"regexp_extract({url}, {_PARTS}, 3)"
    plain = f"CASE WHEN {scheme} IN ({', '.join(q(s) for s in fv.PARAM_SCHEMES)}) THEN regexp_replace({path}, ';[^/]*\\z', '') ELSE {path} END"
    return f"CASE WHEN coalesce({url}, '') = '' THEN '' ELSE regexp_replace({scheme} || '://' || regexp_extract({url}, {_PARTS}, 2) || {plain}, '/+\\z', '') END"


def text_sql(html: str) -> str:
    t = html
    for tag in ("script", "style"):
        t = f"regexp_replace({t}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    for a, b in fv.HTML_ENTITIES:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({t}, '[{_SP}]+', ' ', 'g'), ' ')"


def escape_sql(col: str) -> str:
    for a, b in fv.HTML_ESCAPES:
        col = f"replace({col}, {q(a)}, {q(b)})"
    return col


@query("f1_normalize_url", f"SELECT page_id, {norm_sql('url')} AS norm, {norm_sql(chr(39) + 'x;y/' + chr(39) + ' || url')} AS norm_text FROM pages")
def f1(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.normalize(u).alias("norm"), urls.normalize(F.concat(F.lit("x;y/"), u)).alias("norm_text")
    )


@query(
    "f2_content_id",
    f"""SELECT page_id, md5({norm_sql('url')}) AS by_url,
        md5({norm_sql('url')} || '|' || html) AS by_title,
        md5({norm_sql('url')} || '|' || html || CASE WHEN page_id % 2 = 0 THEN '|2024-01-01' ELSE '' END) AS by_date
        FROM pages""",
)
def f2(spark, sf):
    u, t = F.col("url"), F.col("html")
    day = F.when(F.col("page_id") % 2 == 0, "2024-01-01").when(F.col("page_id") % 4 == 1, "")
    return table(spark, sf, "pages").select(
        "page_id",
        ledger.content_id(u, F.lit("")).alias("by_url"),
        ledger.content_id(u, t).alias("by_title"),
        ledger.content_id(u, t, day).alias("by_date"),
    )


@query("f3_html_to_text", f"SELECT page_id, {text_sql('html')} AS text FROM pages")
def f3(spark, sf):
    return table(spark, sf, "pages").select("page_id", textops.html_to_text(F.col("html")).alias("text"))


@query("f4_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short FROM documents")
def f4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", textops.truncate(F.col("text")).alias("short"))


_FILE_SQL = f"left(regexp_replace(regexp_replace(regexp_replace(text, '[<>:\"/\\\\|?*]', '_', 'g'), '^[{_SP}]+|[{_SP}]+\\z', '', 'g'), '[{_SP}]+', '_', 'g'), 200)"


@query("f5_sanitize_filename", f"SELECT doc_id, {_FILE_SQL} AS name FROM documents")
def f5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", textops.sanitize_filename(F.col("text")).alias("name"))


_DATE_FORMS = [
    ("rfc", "EEE, dd MMM yyyy HH:mm:ss", " GMT"),
    ("rfc_offset", "EEE, dd MMM yyyy HH:mm:ss", " +0000"),
    ("iso", "yyyy-MM-dd'T'HH:mm:ss", ""),
    ("iso_micros", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", ""),
    ("iso_zone", "yyyy-MM-dd'T'HH:mm:ss", "+00:00"),
    ("plain", "yyyy-MM-dd HH:mm:ss", ""),
    ("slashes", "yyyy/MM/dd HH:mm:ss", ""),
]
_LOCAL = "strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M')"


@query(
    "f6_format_date",
    "SELECT event_id, " + ", ".join(f"{_LOCAL} AS {n}" for n, _, _ in _DATE_FORMS)
    + f", {_LOCAL} AS seconds, {_LOCAL} AS millis, strftime(CAST(ts AS DATE) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS day, "
    "'on ' || CAST(CAST(ts AS DATE) AS VARCHAR) AS junk FROM events",
)
def f6(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    rendered = [(n, F.concat(F.date_format(ts, f), F.lit(z))) for n, f, z in _DATE_FORMS]
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rendered += [
        ("seconds", second.cast("string")), ("millis", (second * 1000).cast("string")), ("day", F.date_format(ts, "yyyy-MM-dd")),
        ("junk", F.concat(F.lit("on "), F.date_format(ts, "yyyy-MM-dd"))),
    ]
    return table(spark, sf, "events").select("event_id", *[dates.normalize(c).alias(n) for n, c in rendered])


@query("p4_valid_url", f"SELECT page_id, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') AS valid, false AS valid_path FROM pages")
def p4(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", urls.is_valid(F.col("url")).alias("valid"), urls.is_valid(urls.path(F.col("url"))).alias("valid_path"))


_ROOT = "regexp_extract(url, '^[^/]*//[^/?#]*', 0)"
_BASE_PATH = "regexp_extract(url, '^[^?#]*', 0)"
_DIR = "regexp_extract(url, '^([^/]*//[^/?#]*/(?:[^?#]*/)?)', 1)"
_UP = "regexp_extract(url, '^([^/]*//[^/?#]*/)', 1) || CASE WHEN regexp_matches(url, '^[^/]*//[^/?#]*/[^/?#]+/[^/?#]+/') THEN regexp_extract(url, '^[^/]*//[^/?#]*/([^/?#]+/)', 1) ELSE '' END"


@query(
    "f9_resolve_url",
    f"""SELECT page_id, {_ROOT} || '/a/' || page_id AS rooted, {_DIR} || 'i.png' AS relative, {_UP} || 'z' AS parent,
        {_BASE_PATH} || '?p=' || page_id AS query, regexp_extract(url, '^[^#]*', 0) || '#f' AS fragment,
        regexp_extract(url, '^[^/]*', 0) || '//cdn.example.net/x' AS host, 'mailto:a@b.c' AS other,
        'https://cdn.example.net/y' AS no_base FROM pages""",
)
def f9(spark, sf):
    base, i = F.col("url"), F.col("page_id").cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.resolve(F.concat(F.lit("/a/"), i), base).alias("rooted"),
        urls.resolve(F.lit("./i.png"), base).alias("relative"),
        urls.resolve(F.lit("../z"), base).alias("parent"),
        urls.resolve(F.concat(F.lit("?p="), i), base).alias("query"),
        urls.resolve(F.lit("#f"), base).alias("fragment"),
        urls.resolve(F.lit("//cdn.example.net/x"), base).alias("host"),
        urls.resolve(F.lit("mailto:a@b.c"), base).alias("other"),
        urls.resolve(F.lit("//cdn.example.net/y"), F.lit("")).alias("no_base"),
    )


@query("f11_asset_filename", "SELECT page_id, 'image_' || left(md5(url), 12) || '.jpg' AS filename FROM pages")
def f11(spark, sf):
    return table(spark, sf, "pages").select("page_id", images.asset_filename(F.col("url")).alias("filename"))


@query("f13_escape", f"SELECT page_id, {escape_sql('html')} AS escaped FROM pages")
def f13(spark, sf):
    return table(spark, sf, "pages").select("page_id", textops.escape(F.col("html")).alias("escaped"))


_FENCED = "'```markdown' || chr(10) || text || chr(10) || repeat(chr(39), 3)"


@query(
    "f14_strip_fences",
    f"SELECT doc_id, regexp_replace(regexp_replace({_FENCED}, {q(fv.CODE_FENCE)}, '', 'g'), '^[{_SP}]+|[{_SP}]+\\z', '', 'g') AS body FROM documents",
)
def f14(spark, sf):
    fenced = F.concat(F.lit("```markdown\n"), "text", F.lit("\n'''"))
    return table(spark, sf, "documents").select("doc_id", textops.strip_fences(fenced).alias("body"))


@query(
    "f8_title_template",
    f"""SELECT event_id, event_type || ' ' || strftime(ts, '%Y-%m-%d') || ' (' || strftime(ts, '%Y-%m-%d') || ')' AS shown,
        event_type || ' ' || strftime(ts, '%Y-%m-%d') || ' (' || strftime(ts, '%Y-%m-%d') || ')' AS plain FROM events""",
)
def f8(spark, sf):
    text = F.concat(F.lit("{ "), "event_type", F.lit(" {time}} ({time})"))
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        textops.render_title(text, ts).alias("shown"),
        textops.render_plain_title(F.concat(F.lit(" <b>"), text, F.lit("</br>")), ts).alias("plain"),
    )


_BARE = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"


def _title_text(expr: str) -> str:
    t = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    for a, b in fv.HTML_ENTITIES:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"nullif(regexp_replace({t}, '^[{_SP}]+|[{_SP}]+\\z', '', 'g'), '')"


TITLE_SQL = (
    "coalesce(" + _title_text(f"regexp_extract({_BARE}, '(?is)<title\\b[^>]*>([^<]*)</title', 1)") + ", "
    + _title_text(f"regexp_extract({_BARE}, '(?is)<h1\\b[^>]*>(.*?)</h1', 1)") + ", url)"
)


@query(
    "f15_page_title",
    f"SELECT page_id, {TITLE_SQL} AS title, {TITLE_SQL.replace('(html,', '(replace(html, ' + q('title>') + ', ' + q('t>') + '),')} AS from_h1 FROM pages",
)
def f15(spark, sf):
    none = F.lit(None).cast("string")
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        clean.page_title(html, none, F.col("url")).alias("title"),
        clean.page_title(F.replace(html, F.lit("title>"), F.lit("t>")), none, F.col("url")).alias("from_h1"),
    )


@query(
    "t3_daily_key",
    "SELECT event_id, md5('://' || event_type || '|user ' || user_id || '|' || "
    "strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d')) AS content_id FROM events",
)
def t3(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("url"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return ingest.daily_key(e, "url", "title", "ts").select("event_id", "content_id")


@query(
    "f7_edition_day",
    "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM events",
)
def f7(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.as_of_day(F.col("ts").cast("timestamp")).alias("day"))


@query(
    "s11_paragraphs",
    "WITH " + ARTICLES_SQL + f""", b AS (SELECT doc_id, i, regexp_replace(x, '^[{_SP}]+|[{_SP}]+\\z', '', 'g') AS x FROM (
      SELECT doc_id, unnest(string_split(replace(content, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS x,
             generate_subscripts(string_split(replace(content, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS i FROM art))
    SELECT doc_id, string_agg('<p>' || x || '</p>', '' ORDER BY i) AS html FROM b WHERE x <> '' GROUP BY doc_id""",
)
def s11_paragraphs(spark, sf):
    a = articles(spark, sf)
    return a.select("doc_id", textops.paragraphs(F.replace("content", F.lit("\n"), F.lit("\n\n"))).alias("html")).filter("html <> ''")
