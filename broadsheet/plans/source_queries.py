"""Readers of landed payloads over whole tables.

Payloads are written from the tables (twenty documents to a feed, mailbox or bookmark list) and read by the adapters; the SQL says what must come
out straight from the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import clean, markup, textops
from broadsheet.operators import ledger
from broadsheet.plans import markup_sql as m
from broadsheet.plans.catalog import q, query, table
from broadsheet.plans.scalar_queries import TITLE_SQL, escape_sql
from broadsheet.plans.tree_queries import injected, injected_sql
from broadsheet.sources import bookmarks, config, feeds, forecast, mail, scratch, trending, web

PER_PAYLOAD = 20
_CONTROL = r"[\x00-\x08\x0b-\x1f\x7f\x{fffe}\x{ffff}]"
#: as much of a text as holds its first forty letters, ampersands and blanks
_HEAD = r"^(?:[^A-Za-z& ]*+[A-Za-z& ]){0,40}"


def _docs(spark, sf: str) -> DataFrame:
    """documents as items of payloads: feed, place in it, and a text that XML can carry."""
    d = table(spark, sf, "documents")
    clean_text = F.regexp_replace(F.coalesce("text", F.lit("")), _CONTROL, "")
    return d.select(
        "doc_id", F.floor(F.col("doc_id") / PER_PAYLOAD).cast("int").alias("feed"), (F.col("doc_id") % PER_PAYLOAD).cast("int").alias("k"),
        clean_text.alias("body"), F.left(F.regexp_replace(F.regexp_extract(clean_text, _HEAD, 0), r"[^A-Za-z& ]+", ""), F.lit(40)).alias("head"), "lang",
    )


_DOCS_SQL = f"""doc AS (SELECT doc_id, CAST(doc_id // {PER_PAYLOAD} AS INT) AS feed, CAST(doc_id % {PER_PAYLOAD} AS INT) AS k, regexp_replace(coalesce(text, ''), '{_CONTROL}', '', 'g') AS body, lang FROM documents),
    d AS (SELECT *, left(regexp_replace(body, '[^A-Za-z& ]+', '', 'g'), 40) AS head, row_number() OVER (PARTITION BY feed ORDER BY doc_id) - 1 AS i FROM doc)"""


def _configured(df: DataFrame, column: str = "feed") -> DataFrame:
    """A source for each payload, with options that differ by its number."""
    pos = F.col("source_pos")
    none = F.lit(None).cast("string")
    return df.select(F.col(column).alias("source_pos")).distinct().select(
        "source_pos", F.lit("rss").alias("type"), F.concat(F.lit("ns."), pos.cast("string")).alias("src"), none.alias("title"),
        F.when(pos % 2 == 0, "Y").otherwise("N").alias("full_text"), F.when(pos % 7 == 3, "The, zz").alias("delete"), none.alias("goal"), none.alias("model"),
        F.when(pos % 3 == 1, F.create_map(F.lit("limit"), F.lit("5"))).alias("metadata"),
    )


# --- S3: feeds ------------------------------------------------------------------------------------------------------
def _x(c):
    return textops.escape(c)


def feed_payloads(spark, sf: str) -> DataFrame:
    """RSS, Atom and RDF documents; by feed % 5: RSS, Atom, RDF, RSS cut short, no entries or no feed at all."""
    d = _docs(spark, sf)
    i = F.col("doc_id").cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    link = F.concat(F.lit("https://f.example.org/"), i, F.lit("?a=1&amp;b=2"))
    html = F.concat(F.lit("<p>"), _x(F.col("body")), F.lit('</p><img src="/i'), i, F.lit('.png">'))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    title = F.when(F.col("k") % 6 != 5, tag("title", _x(F.col("head")))).otherwise("")
    rss = F.concat(
        F.lit("<item>"), title, F.when(F.col("k") % 5 == 2, tag("guid", link)).otherwise(tag("link", link)), tag("dc:creator", F.concat(F.lit("A "), i)),
        tag("pubDate", F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), F.lit("<category>c1</category><category>c2</category><description>short</description>"),
        tag("content:encoded", _x(html)), F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry>"), title, F.lit('<link rel="self" href="https://f.example.org/self"/><link rel="alternate" href="'), link, F.lit('"/><author><name>A '), i,
        F.lit("</name></author>"), tag("published", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit('<category term="t1"/>'),
        F.when(F.col("k") % 2 == 1, tag("summary", _x(html))).otherwise(F.concat(tag("summary", F.lit("short")), tag("content", _x(html)))), F.lit("</entry>"),
    )
    rdf = F.concat(F.lit("<item>"), title, tag("link", link), tag("description", F.when(F.col("k") % 4 == 1, "").otherwise(_x(html))), F.lit("</item>"))
    kind = F.col("feed") % 5
    one = F.when(kind == 1, atom).when(kind == 2, rdf).otherwise(rss)
    # a payload has at most twenty documents
    joined = d.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("x")))), lambda e: e["x"]), "").alias("x"))
    name = tag("title", F.concat(F.lit("Feed &amp; "), F.col("feed").cast("string")))
    head = '<?xml version="1.0" encoding="UTF-8"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'
    payload = (
        F.when(kind == 0, F.concat(F.lit(head), name, F.col("x"), F.lit("</channel></rss>")))
        .when(kind == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), name, F.col("x"), F.lit("</feed>")))
        .when(kind == 2, F.concat(F.lit("<RDF><channel>"), name, F.lit("</channel>"), F.col("x"), F.lit("</RDF>")))
        .when(kind == 3, F.concat(F.lit(head), name, F.col("x"), F.lit("<item><title>R & D</title><link>https://f.example.org/stray</link><description>x</description></item><item><title>cut")))
        .when(F.col("feed") % 2 == 0, F.concat(F.lit(head), name, F.lit("</channel></rss>")))
        .otherwise("<rss")
    )
    return joined.select(F.col("feed").alias("source_pos"), payload.alias("payload"))


_LINK = "'https://f.example.org/' || doc_id || '?a=1&b=2'"
_HTML = f"'<p>' || {escape_sql('body')} || '</p><img src=\"/i' || doc_id || '.png\">'"
_FEED_SQL = f"""WITH {_DOCS_SQL}, f AS (SELECT *, feed % 5 AS kind, CASE WHEN k % 6 = 5 THEN 'No Title' ELSE {m.strip('head')} END AS title FROM d WHERE i < CASE WHEN feed % 3 = 1 THEN 5 ELSE 15 END)
    SELECT feed AS source_pos, CAST(i AS INT) AS item_pos, title, md5({_HTML}) AS content, {_LINK} AS url, CASE WHEN kind = 2 THEN '' ELSE 'A ' || doc_id END AS author,
        CASE WHEN kind = 2 THEN '' ELSE strftime(TIMESTAMP '2024-01-01 08:00:00' + INTERVAL 1 MINUTE * doc_id, '%Y-%m-%d %H:%M') END AS published_date,
        'https://f.example.org/i' || doc_id || '.png' AS image, CASE kind WHEN 2 THEN '' WHEN 1 THEN 't1' ELSE 'c1,c2' END AS categories
    FROM f WHERE kind < 4 AND NOT (kind = 2 AND k % 4 = 1) AND NOT (feed % 7 = 3 AND (contains(title, 'The') OR contains(title, 'zz')))
    UNION ALL SELECT feed, CAST(n AS INT), 'R & D', md5('x'), 'https://f.example.org/stray', '', '', '', '' FROM (SELECT feed, count(*) AS n FROM d WHERE feed % 5 = 3 GROUP BY feed) WHERE n < CASE WHEN feed % 3 = 1 THEN 5 ELSE 15 END"""


@query("s3_feed_articles", _FEED_SQL)
def s3(spark, sf):
    from broadsheet.operators import filters

    payloads = feed_payloads(spark, sf)
    sources = _configured(payloads, "source_pos")
    rows, _ = feeds.parse_feed(payloads, sources)
    kept = filters.drop_titles(feeds.summaries(rows), sources)
    return kept.select(
        "source_pos", "item_pos", "title", F.md5("content").alias("content"), "url", "author", "published_date", F.array_join("images", " ").alias("image"),
        F.coalesce(F.col("metadata")["categories"], F.lit("")).alias("categories"),
    )


@query(
    "s3_feed_runs",
    f"""WITH {_DOCS_SQL} SELECT DISTINCT feed AS source_pos, feed % 5 < 4 AS success, CASE WHEN feed % 5 = 4 THEN 'Failed to parse RSS feed: ' || CASE WHEN feed % 2 = 0 THEN 'No entries found' ELSE 'not well-formed' END END AS error,
    CASE WHEN feed % 5 < 4 THEN 'Feed & ' || feed END AS source_title FROM d""",
)
def s3_runs(spark, sf):
    payloads = feed_payloads(spark, sf)
    return feeds.parse_feed(payloads, _configured(payloads, "source_pos"))[1]


# --- S12, S4, X1: pages ---------------------------------------------------------------------------------------------
_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g')"
_ARTICLE = f"regexp_extract({_BARE}, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1)"


@query(
    "s12_full_text",
    f"""WITH {_DOCS_SQL}, p AS (SELECT page_id, url FROM pages), b AS (SELECT url, min(html) AS html FROM pages GROUP BY url),
    r AS (SELECT d.*, coalesce(p.url, 'https://lost.example.org/' || doc_id) AS link FROM d LEFT JOIN p ON p.page_id = d.doc_id)
    SELECT feed AS source_pos, k AS item_pos, link AS url, CASE WHEN feed % 2 = 0 THEN md5({_ARTICLE}) ELSE md5(body) END AS content
    FROM r LEFT JOIN b ON b.url = link WHERE CASE WHEN feed % 2 = 0 THEN b.url IS NOT NULL ELSE body <> '' END""",
)
def s12(spark, sf):
    pages = table(spark, sf, "pages")
    d = _docs(spark, sf)
    linked = d.join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    rows = linked.select(
        F.col("feed").alias("source_pos"), F.col("k").alias("item_pos"), F.col("head").alias("title"), F.col("body").alias("content"),
        F.coalesce("url", F.concat(F.lit("https://lost.example.org/"), F.col("doc_id").cast("string"))).alias("url"),
    )
    return feeds.enrich_full_text(rows, pages.select("url", "html"), _configured(d)).select("source_pos", "item_pos", "url", F.md5("content").alias("content"))


@query(
    "s4_page_articles",
    f"SELECT CAST(page_id AS INT) AS source_pos, {TITLE_SQL} AS title, md5({_ARTICLE}) AS content, url FROM pages WHERE page_id % 3 <> 2",
)
def s4(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("int").alias("source_pos"), "url", F.when(F.col("page_id") % 3 == 2, "<html><body><nav>x</nav></body></html>").otherwise(F.col("html")).alias("html"))
    sources = pages.select("source_pos", F.col("url").alias("src"), F.lit(None).cast("string").alias("title"))
    return web.to_articles(pages, sources)[0].select("source_pos", "title", F.md5("content").alias("content"), "url")


@query("s4_page_runs", "SELECT CAST(page_id AS INT) AS source_pos, page_id % 3 <> 2 AS success, CASE WHEN page_id % 3 = 2 THEN 'Failed to extract content from webpage' END AS error FROM pages")
def s4_runs(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("int").alias("source_pos"), "url", F.when(F.col("page_id") % 3 == 2, "<html><body><nav>x</nav></body></html>").otherwise(F.col("html")).alias("html"))
    sources = pages.select("source_pos", F.col("url").alias("src"), F.lit(None).cast("string").alias("title"))
    return web.to_articles(pages, sources)[1].select("source_pos", "success", "error")


_RELATED = '<aside>side {id}</aside><div>plain text {id} <a href="/x">short</a> goes on</div><div><a href="/a">dense one</a> <a href="/b">dense two</a> x</div><ul><li><a href="/c">only link</a></li><li>item</li></ul><graphic src="/g.png"/>'


def _main_sql() -> str:
    s = m.Script()
    s.add("inj", injected_sql(_RELATED))
    s.add("src", "SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(replace(html, '<article>', '<main id=\"m\">'), '</article>', '</main>') ELSE replace(replace(html, '<article>', '<div>'), '</article>', '</div>') END AS html FROM inj")
    s.add("bare", f"SELECT page_id, url, {_BARE} AS html FROM src")
    s.add("marked", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(html, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1) ELSE regexp_extract(html, '(?is)<main\\b[^>]*>(.*)</main\\s*>', 1) END AS html FROM bare WHERE page_id % 3 < 2")
    s.add("other", "SELECT * FROM bare WHERE page_id % 3 = 2")
    gone = f"CASE WHEN name IN {m.names(['nav', 'header', 'footer', 'aside', *fv.ACTIVE_TAGS, 'head'])} THEN 'cut' ELSE 'keep' END"
    s.add("left1", f"SELECT page_id, '' AS url, html FROM {m.rebuild(s, 'b', m.keep_all(s, 'a', m.tokens(s, 'a', 'other'), gone))}")
    t = m.tokens(s, "d", "left1")
    edge = f"name IN {m.names([*fv.BLOCK_TAGS, *fv.TABLE_PART_TAGS, 'body', 'html'])}"
    s.add("runs1", f"SELECT *, {edge} AS edge, sum(CAST({edge} AS INT)) OVER (PARTITION BY page_id ORDER BY pos) AS run FROM {t}")
    s.add("runs2", "SELECT *, arg_max(kind, CASE WHEN name = 'a' AND kind IN ('open', 'close') THEN pos END) OVER (PARTITION BY page_id, run ORDER BY pos) AS state FROM runs1")
    s.add("dense", f"""SELECT page_id, run, sum(n) AS total, sum(CASE WHEN state = 'open' THEN n ELSE 0 END) AS linked FROM
        (SELECT *, CASE WHEN kind = 'text' THEN length({m.strip('raw')}) ELSE 0 END AS n FROM runs2) GROUP BY ALL""")
    s.add("left2", f"""SELECT page_id, '' AS url, string_agg(CASE WHEN NOT edge AND linked > {clean.MAX_LINK_SHARE} * total AND total > 0 THEN '' ELSE raw END, '' ORDER BY pos) AS html
        FROM runs1 JOIN dense USING (page_id, run) GROUP BY page_id""")
    done = m.rebuild(s, "g", m.keep_all(s, "f", m.tokens(s, "f", m.without_empty(s, "e", "left2")), m.SHELL))
    return s.query(f"""SELECT page_id, regexp_replace(html, '(?i)(</?)graphic', '\\1img', 'g') AS body FROM (SELECT page_id, html FROM marked UNION ALL SELECT page_id, html FROM {done})""")


@query("x1_main_content", _main_sql())
def x1(spark, sf):
    p = injected(spark, sf, _RELATED)
    kind = F.col("page_id") % 3
    as_main = F.replace(F.replace("html", F.lit("<article>"), F.lit('<main id="m">')), F.lit("</article>"), F.lit("</main>"))
    as_div = F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>"))
    return p.select("page_id", clean.main_content(F.when(kind == 0, F.col("html")).when(kind == 1, as_main).otherwise(as_div)).alias("body"))


# --- S5, S6, X22: mail ----------------------------------------------------------------------------------------------
_TAGGED = '<p CLASS="c" 1bad="x" Data-X=\'1\' @click="f">'


def mail_payloads(spark, sf: str) -> DataFrame:
    """Mailboxes of twenty mails; every sixth answers with an error."""
    d = _docs(spark, sf)
    i = F.col("doc_id").cast("string")
    tag = F.element_at(F.lit(["news", "news-a", "ads"]), (F.col("doc_id") % 3 + 1).cast("int"))
    one = F.struct(
        F.when(F.col("k") % 4 != 3, F.col("head")).alias("subject"), F.concat(F.lit("u"), i, F.lit("@e.org")).alias("from"), F.when(F.col("k") % 2 == 0, F.lit("me@e.org")).alias("to"),
        F.when(F.col("k") % 3 != 2, F.concat(F.lit(_TAGGED), _x(F.col("body")), F.lit('<img src="/m'), i, F.lit('.png">'))).otherwise("").alias("html"),
        F.when(F.col("k") % 3 == 2, F.col("head")).alias("text"), ((F.lit(1704067200) + (F.col("doc_id") * 7919 % 1009) * 60) * 1000).cast("string").alias("timestamp"),
        tag.alias("tag"), F.when(F.col("k") % 5 == 0, F.array(F.lit("a.pdf"), F.lit("b.pdf"))).alias("attachments"),
    )
    boxes = d.groupBy("feed").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("e")))), lambda x: x["e"]).alias("emails"))
    good = F.to_json(F.struct(F.lit("success").alias("result"), "emails"))
    bad = F.to_json(F.struct(F.lit("fail").alias("result"), F.when(F.col("feed") % 12 == 11, F.lit(None)).otherwise(F.concat(F.lit("bad key "), F.col("feed").cast("string"))).alias("message")))
    return boxes.select(F.col("feed").alias("source_pos"), F.when(F.col("feed") % 6 == 5, bad).otherwise(good).alias("payload"))


def _mail_sources(df: DataFrame) -> DataFrame:
    """By source % 5: no options; a tag in the address; a tag option; prefix, span and offset; a limit beyond the page limit."""
    pos = F.col("source_pos")
    n = pos % 5
    pairs = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    meta = (
        F.when(n == 2, pairs("tag", "ads", "limit", "3")).when(n == 3, pairs("tag_prefix", "news", "timestamp_from", "1704070000000", "timestamp_to", "1704110000000", "offset", "1"))
        .when(n == 4, pairs("limit", "500")).when(n == 1, F.create_map().cast("map<string,string>"))
    )
    src = F.concat(F.lit("n s"), pos.cast("string"), F.when(n.isin(1, 2), " . news").otherwise(""))
    return df.select("source_pos").distinct().select("source_pos", src.alias("src"), meta.alias("metadata"))


_STAMP = "(1704067200 + (doc_id * 7919 % 1009) * 60) * 1000"
_TAG = "(['news', 'news-a', 'ads'])[doc_id % 3 + 1]"
_MAILS_SQL = f"""ml AS (SELECT *, {_STAMP} AS stamp, {_TAG} AS tag, feed % 5 AS n FROM d WHERE feed % 6 <> 5),
    sel AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY stamp DESC, i) AS rank FROM ml
        WHERE CASE n WHEN 1 THEN tag = 'news' WHEN 2 THEN tag = 'ads' WHEN 3 THEN starts_with(tag, 'news') AND stamp BETWEEN 1704070000000 AND 1704110000000 ELSE true END),
    pick AS (SELECT * FROM (SELECT *, rank - CASE n WHEN 3 THEN 1 ELSE 0 END - 1 AS place FROM sel) WHERE place >= 0 AND place < CASE n WHEN 2 THEN 3 WHEN 4 THEN 100 ELSE 15 END)"""
_MAIL_BODY = f"""CASE WHEN k % 3 <> 2 THEN '<p class="c" data-x=''1''>' || {escape_sql('body')} || '<img src="/m' || doc_id || '.png"></p>' ELSE '<p>' || head || '</p>' END"""


@query(
    "s5_mail_articles",
    f"""WITH {_DOCS_SQL}, {_MAILS_SQL}
    SELECT feed AS source_pos, CAST(place AS INT) AS item_pos, CASE WHEN k % 4 = 3 THEN 'No Subject' ELSE head END AS title, md5({_MAIL_BODY}) AS content, 'mailto:u' || doc_id || '@e.org' AS url,
        strftime(make_timestamp(stamp * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS published_date, CASE WHEN k % 3 <> 2 THEN '/m' || doc_id || '.png' ELSE '' END AS images,
        CASE WHEN k % 2 = 0 THEN 'me@e.org' ELSE '' END AS sent_to, CASE WHEN k % 5 = 0 THEN 'a.pdf,b.pdf' ELSE '' END AS attachments FROM pick""",
)
def s5(spark, sf):
    payloads = mail_payloads(spark, sf)
    rows = mail.parse(payloads, _mail_sources(payloads))[0]
    return rows.select(
        "source_pos", "item_pos", "title", F.md5("content").alias("content"), "url", "published_date", F.array_join("images", " ").alias("images"),
        F.col("metadata")["to"].alias("sent_to"), F.col("metadata")["attachments"].alias("attachments"),
    )


@query(
    "s5_mail_runs",
    f"""WITH {_DOCS_SQL} SELECT DISTINCT feed AS source_pos, feed % 6 <> 5 AS success, CASE WHEN feed % 6 = 5 THEN 'API error: ' || CASE WHEN feed % 12 = 11 THEN 'Unknown API error' ELSE 'bad key ' || feed END END AS error FROM d""",
)
def s5_runs(spark, sf):
    return mail.parse(mail_payloads(spark, sf))[1].select("source_pos", "success", "error")


@query(
    "s6_mail_query",
    """WITH e AS (SELECT event_id, CAST(user_id % 5 AS INT) AS s, event_type AS tag, epoch_ms(ts) AS stamp FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY stamp DESC, event_id) AS rank FROM e
          WHERE CASE s WHEN 1 THEN tag = 'click' WHEN 2 THEN tag = 'view' AND stamp <= 1705000000000 WHEN 3 THEN starts_with(tag, 's') AND stamp >= 1704500000000 ELSE true END)
    SELECT s AS source_pos, event_id, CAST(rank - CASE s WHEN 3 THEN 7 ELSE 0 END - 1 AS INT) AS item_pos FROM r
    WHERE rank > CASE s WHEN 3 THEN 7 ELSE 0 END AND rank <= CASE s WHEN 0 THEN 150 WHEN 1 THEN 150 WHEN 3 THEN 107 WHEN 4 THEN 20 ELSE 100 END""",
)
def s6(spark, sf):
    mails = table(spark, sf, "events").select(
        (F.col("user_id") % 5).cast("int").alias("source_pos"), F.col("event_id").alias("item_pos"), F.col("event_id"), F.col("event_type").alias("tag"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
    )
    sources = spark.createDataFrame(
        [(0, "store", None), (1, "st ore.click", {}), (2, "store.click", {"tag": "view", "timestamp_to": "1705000000000"}),
         (3, "store", {"tag_prefix": "s", "timestamp_from": "1704500000000", "offset": "7", "limit": "1000"}), (4, "store", {"limit": "20"})],
        "source_pos int, src string, metadata map<string,string>",
    )
    return mail.select_mails(mails, sources, 150).select("source_pos", "event_id", F.col("item_pos").cast("int").alias("item_pos"))


def _sanitized_sql() -> str:
    s = m.Script()
    s.add("src", injected_sql(_TAGGED + 'x<B ID="i{id}" _ok:y=1 a.b-c="2" -no="3">bold</B><br CLEAR>'))
    t = m.tokens(s, "a", "src")
    an = "lower(regexp_extract(a, '^[^\\s=]+'))"
    kept = f"list_transform(list_filter(attrs, lambda a: regexp_matches({an}, {q(fv.XML_ATTR_NAME)})), lambda a: ' ' || {an} || substr(a, length({an}) + 1))"
    tag = f"CASE WHEN kind IN ('open', 'void') AND regexp_matches(raw, '\\s') THEN '<' || name || array_to_string({kept}, '') || CASE WHEN ends_with(raw, '/>') THEN '/>' ELSE '>' END ELSE raw END"
    s.add("tags", f"SELECT page_id, url, string_agg({tag}, '' ORDER BY pos) AS html FROM {t} GROUP BY ALL")
    return s.query(f"SELECT page_id, html FROM {m.rebuild(s, 'c', m.keep_all(s, 'b', m.tokens(s, 'b', 'tags'), m.SHELL))}")


@query("x22_sanitize_attributes", _sanitized_sql())
def x22(spark, sf):
    p = injected(spark, sf, _TAGGED + 'x<B ID="i{id}" _ok:y=1 a.b-c="2" -no="3">bold</B><br CLEAR>')
    return p.select("page_id", mail.sanitize_attrs(F.col("html")).alias("html"))


# --- S7: bookmarks --------------------------------------------------------------------------------------------------
def bookmark_payloads(spark, sf: str) -> DataFrame:
    d = _docs(spark, sf).join(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    i = F.col("doc_id").cast("string")
    one = F.struct(F.col("head").alias("title"), F.coalesce("url", F.concat(F.lit("https://lost.example.org/"), i)).alias("link"), F.when(F.col("k") % 4 != 1, F.left("body", F.lit(60))).alias("excerpt"),
                   F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), i, F.lit(".png"))).otherwise("").alias("cover"))
    lists = d.groupBy("feed").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("e")))), lambda x: x["e"]).alias("items"))
    ok = F.to_json(F.struct((F.col("feed") % 6 != 4).alias("result"), F.when(F.col("feed") % 12 == 4, "down").alias("message"), "items"))
    return lists.select(F.col("feed").alias("source_pos"), ok.alias("payload"))


@query(
    "s7_bookmarks",
    f"""WITH {_DOCS_SQL}, p AS (SELECT page_id, url FROM pages), b AS (SELECT url, min(html) AS html FROM pages GROUP BY url),
    r AS (SELECT d.*, coalesce(p.url, 'https://lost.example.org/' || doc_id) AS link FROM d LEFT JOIN p ON p.page_id = d.doc_id WHERE feed % 6 <> 4 AND i < 15)
    SELECT feed AS source_pos, CAST(i AS INT) AS item_pos, head AS title, link AS url, CASE WHEN k % 3 = 0 THEN 'c' || doc_id || '.png' ELSE '' END AS images,
        md5(CASE WHEN feed % 2 = 0 AND b.url IS NOT NULL THEN {_ARTICLE} ELSE '<p>' || CASE WHEN k % 4 = 1 THEN '' ELSE left(body, 60) END || '</p>' END) AS content FROM r LEFT JOIN b ON b.url = link""",
)
def s7(spark, sf):
    payloads = bookmark_payloads(spark, sf)
    rows = bookmarks.parse(payloads, table(spark, sf, "pages").select("url", "html"), _configured(payloads, "source_pos"))[0]
    return rows.select("source_pos", "item_pos", "title", "url", F.array_join("images", " ").alias("images"), F.md5("content").alias("content"))


# --- S8, S9: forecasts ----------------------------------------------------------------------------------------------
_FIELDS = forecast._FIELDS
#: by customer % 10: which day is asked for
_WANTED = [None, "today", "tomorrow", "2", "1", "2024-03-02", "2024-12-31", " Today ", None, "0"]


def _forecast(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    n = key % 13
    some = lambda d: F.struct(*[
        (F.lit(f"2024-03-0{d + 1}") if f == "fxDate" else F.when((key + k + d) % 7 != 0, F.concat(F.lit(f"{f}{d}-"), key.cast("string")))).alias(f) for k, f in enumerate(_FIELDS)
    ])
    days = F.when(n == 3, F.array(some(0))).when(n == 4, F.slice(F.array(some(0)), 1, 0)).otherwise(F.array(some(0), some(1), some(2)))
    place = F.struct(F.concat(F.lit("p"), key.cast("string")).alias("id"), F.when(n != 6, F.concat(F.lit("City "), F.col("c_name"))).alias("name"))
    geo = F.struct(F.when(n == 1, "404").otherwise("200").alias("code"), F.when(n == 2, F.slice(F.array(place), 1, 0)).otherwise(F.array(place)).alias("location"))
    daily = F.struct(F.when(n == 5, "500").otherwise("200").alias("code"), F.when(n == 5, "busy").alias("msg"), days.alias("daily"))
    payloads = c.select(key.cast("int").alias("source_pos"), F.to_json(geo).alias("geo"), F.to_json(daily).alias("daily"))
    wanted = F.element_at(F.array(*[F.lit(w).cast("string") for w in _WANTED]), (key % 10 + 1).cast("int"))
    sources = c.select(key.cast("int").alias("source_pos"), F.col("c_name").alias("src"), F.when(wanted.isNotNull(), F.create_map(F.lit("date"), wanted)).alias("metadata"))
    return forecast.parse(payloads, sources)


_ASKED = "(['tomorrow', 'today', 'tomorrow', '2', '1', '2024-03-02', '2024-12-31', 'today', 'tomorrow', '0'])[CAST(c_custkey % 10 + 1 AS INT)]"
_FORECAST_SQL = f"""c AS (SELECT CAST(c_custkey AS INT) AS source_pos, c_custkey, c_name, c_custkey % 13 AS n, {_ASKED} AS asked, c_custkey % 10 IN (0, 8) AS none,
        CASE {_ASKED} WHEN 'today' THEN 0 WHEN '0' THEN 0 WHEN 'tomorrow' THEN 1 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '2024-03-02' THEN 1 END AS d,
        CASE c_custkey % 13 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 3 END AS days, CASE WHEN c_custkey % 13 = 6 THEN c_name ELSE 'City ' || c_name END AS city FROM customer),
    e AS (SELECT *, d IS NOT NULL AND d < days AS found,
        CASE WHEN n = 1 THEN 'Error from API (geo lookup): 404 - Unknown error' WHEN n = 2 THEN 'Could not resolve city ''' || c_name || ''' via GeoAPI.' WHEN n = 5 THEN 'Error from API (weather): 500 - busy'
             WHEN days = 0 THEN 'No forecast data available.' WHEN d IS NOT NULL AND d < days THEN NULL WHEN none THEN {q(fv.FORECAST_TOO_SHORT)} WHEN asked IN ('tomorrow', '1') THEN {q(fv.FORECAST_NO_TOMORROW)}
             WHEN asked = '2' THEN {q(fv.FORECAST_NO_DAY_AFTER)} ELSE 'Could not find forecast for date or index ''' || asked || '''.' END AS error FROM c)"""


def _filled(template: str) -> str:
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece == "{city}":
            parts.append("city")
        elif piece == "{fxDate}":
            parts.append("'2024-03-0' || (d + 1)")
        elif piece.startswith("{"):
            f = piece[1:-1]
            parts.append(f"CASE WHEN (c_custkey + {_FIELDS.index(f)} + d) % 7 <> 0 THEN '{f}' || d || '-' || c_custkey ELSE 'N/A' END")
        elif piece:
            parts.append(q(piece))
    return " || ".join(f"({p})" for p in parts)


_BODY = " || ".join(q(f"<p class='weather-item'><strong>{label}：</strong>") + " || " + _filled(text) + " || '</p>'" for label, text in fv.FORECAST_PARAGRAPHS)


@query(
    "s9_forecast_reports",
    f"WITH {_FORECAST_SQL} SELECT source_pos, {_filled(fv.FORECAST_TITLE)} AS title, {_BODY} AS content, '{forecast.REPORT_URL}#2024-03-0' || (d + 1) AS url, '2024-03-0' || (d + 1) AS published_date FROM e WHERE error IS NULL",
)
def s9(spark, sf):
    return _forecast(spark, sf)[0].select("source_pos", "title", "content", "url", "published_date")


@query("s8_forecast_runs", f"WITH {_FORECAST_SQL} SELECT source_pos, error IS NULL AS success, error, CASE WHEN error IS NULL THEN {_filled(fv.FORECAST_SOURCE_TITLE)} END AS source_title FROM e")
def s8(spark, sf):
    return _forecast(spark, sf)[1]


# --- S10, S11: trends -----------------------------------------------------------------------------------------------
_AS_OF = "2024-05-06 20:00:00"


def _topics(spark, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.cast("int").alias("source_pos"), F.lit("trending").alias("type"), F.col("c_name").alias("src"), F.when(key % 4 == 0, F.concat(F.lit("Own "), F.col("c_mktsegment"))).alias("title"),
        F.when(key % 3 != 0, F.concat(F.lit("goal of "), F.col("c_mktsegment"))).alias("goal"), F.when(key % 5 == 0, "m/one").when(key % 5 == 1, "").alias("model"),
    )


def _results(spark, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("int").alias("source_pos"), F.col("o_orderkey").alias("rank"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("content"))


_PROMPT_SQL = q(trending.TEMPLATE).replace("{date}", "2024年05月07日")


@query(
    "s10_trend_prompts",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders QUALIFY i <= {fv.MAX_SEARCH_RESULTS}),
    c AS (SELECT o_custkey, string_agg('[' || i || '] ' || CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority ELSE 'None' END || ': ' || o_orderstatus || chr(10), '' ORDER BY i) AS context FROM r GROUP BY o_custkey)
    SELECT CAST(c_custkey AS INT) AS source_pos, replace(replace(replace({_PROMPT_SQL}, '{{topic}}', c_name), '{{goal}}', CASE WHEN c_custkey % 3 <> 0 THEN 'goal of ' || c_mktsegment ELSE {q(fv.DEFAULT_TREND_GOAL)} END),
        '{{context}}', coalesce({q(trending.CONTEXT_HEAD)} || context, '')) AS prompt, CASE WHEN c_custkey % 5 = 0 THEN 'm/one' ELSE {q(fv.DEFAULT_MODEL)} END AS model FROM customer LEFT JOIN c ON o_custkey = c_custkey""",
)
def s10(spark, sf):
    return trending.build_prompts(_topics(spark, sf), _results(spark, sf), F.lit(_AS_OF).cast("timestamp"))


def _completions(spark, sf: str) -> DataFrame:
    """documents as completions of the topics that have their number, fenced; some empty or without a choice."""
    d = _docs(spark, sf)
    text = F.when(F.col("doc_id") % 9 == 4, "").otherwise(F.concat(F.lit("```markdown\n"), F.col("body"), F.lit("\n \n"), F.col("head"), F.lit("\n```\n")))
    message = F.struct(F.struct(F.when(F.col("doc_id") % 9 != 5, text).alias("content")).alias("message"))
    choices = F.when(F.col("doc_id") % 9 == 6, F.slice(F.array(message), 1, 0)).otherwise(F.array(message))
    return d.select(F.col("doc_id").cast("int").alias("source_pos"), F.to_json(F.struct(choices.alias("choices"))).alias("payload"))


@query(
    "s11_trend_articles",
    f"""WITH {_DOCS_SQL}, t AS (SELECT *, regexp_replace('```markdown' || chr(10) || body || chr(10) || ' ' || chr(10) || head || chr(10) || '```' || chr(10), {q(fv.CODE_FENCE)}, '', 'g') AS text FROM d JOIN customer ON c_custkey = doc_id WHERE doc_id % 9 NOT IN (4, 5, 6)),
    b AS (SELECT *, list_filter(list_transform(regexp_split_to_array({m.strip('text')}, '\\n[ \\t]*\\n'), lambda x: {m.strip('x')}), lambda x: x <> '') AS blocks FROM t)
    SELECT CAST(doc_id AS INT) AS source_pos, CASE WHEN doc_id % 4 = 0 THEN 'Own ' || c_mktsegment ELSE {q(fv.DEFAULT_TREND_TITLE)} || c_name END AS title,
        md5(array_to_string(list_transform(blocks, lambda x: '<p>' || x || '</p>'), '')) AS content, c_name AS url, '2024-05-07' AS published_date, CASE WHEN doc_id % 5 = 0 THEN 'm/one' ELSE 'default' END AS model,
        CAST(doc_id IN (SELECT o_custkey FROM orders) AS VARCHAR) AS searched FROM b""",
)
def s11(spark, sf):
    rows = trending.parse(_completions(spark, sf), _topics(spark, sf), F.lit(_AS_OF).cast("timestamp"), _results(spark, sf))[0]
    return rows.select("source_pos", "title", F.md5("content").alias("content"), "url", "published_date", F.col("metadata")["model"].alias("model"), F.col("metadata")["has_search_context"].alias("searched"))


# --- S13, S14: the ledger as a file ---------------------------------------------------------------------------------
@query(
    "s13_ledger_lines",
    "SELECT md5(CAST(doc_id AS VARCHAR)) AS content_id, count(*) AS n FROM documents WHERE doc_id % 4 <> 3 GROUP BY 1",
)
def s13(spark, sf):
    path = scratch.folder(spark, "ledger-lines")
    d = table(spark, sf, "documents")
    own = F.md5(F.col("doc_id").cast("string"))
    line = F.when(F.col("doc_id") % 4 == 3, " \t").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("\t "), own, F.lit(" \r"))).otherwise(own)
    d.select(line.alias("value")).write.text(path)
    return ledger.read_text(spark, path).groupBy("content_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s14_ledger_append",
    "SELECT DISTINCT md5(lang || '|' || doc_id % 100) AS content_id, CAST(doc_id % 3 AS BIGINT) AS run_id FROM documents WHERE doc_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY lang, doc_id % 100 ORDER BY doc_id % 3) = 1",
)
def s14(spark, sf):
    """Two runs, the first one twice; each run appends only ids that the ledger lacks."""
    path = scratch.folder(spark, "ledger")
    d = table(spark, sf, "documents").select(F.md5(F.concat_ws("|", "lang", (F.col("doc_id") % 100).cast("string"))).alias("content_id"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 3).alias("run"))
    for run in (0, 0, 1):
        known = ledger.read(spark, path).filter(F.col("run_id") != run)
        fresh = d.filter(F.col("run") == run).groupBy("content_id").agg(F.min("ord").alias("ord")).join(known.select("content_id"), "content_id", "left_anti")
        ledger.append(spark, fresh, path, run)
    return ledger.read(spark, path).select("content_id", "run_id")


# --- S1, S2, G2: configuration --------------------------------------------------------------------------------------
@query(
    "s2_validate_sources",
    "SELECT CAST(p_partkey AS INT) AS source_pos, CASE WHEN p_partkey % 5 = 4 THEN 'Invalid type: fax' WHEN p_partkey % 7 = 0 THEN 'src is required' ELSE 'ok' END AS verdict, "
    f"CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 7 <> 0 THEN p_size END AS priority, CASE WHEN p_partkey % 5 = 3 AND p_partkey % 7 <> 0 THEN {q(fv.DEFAULT_TREND_GOAL)} END AS goal FROM part",
)
def s2(spark, sf):
    """part as a configuration document's entries."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    none = F.lit(None).cast("string")
    raw = p.select(
        key.alias("source_pos"), F.element_at(F.lit(["rss", "web", "mail", "trending", "fax"]), (key % 5 + 1).cast("int")).alias("type"), F.when(key % 7 != 0, F.col("p_name")).otherwise("").alias("src"),
        F.col("p_size").cast("string").alias("priority"), *[none.alias(c) for c in ("title", "keep_link", "full_text")], F.lit(None).cast("array<struct<type:string,value:string>>").alias("exclude"),
        *[none.alias(c) for c in ("delete", "goal", "model")], F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    ok, bad = config.validate(config.shape(raw), ["mail", "rss", "trending", "web"])
    return ok.select("source_pos", F.lit("ok").alias("verdict"), "priority", "goal").unionByName(
        bad.select("source_pos", F.col("reason").alias("verdict"), F.lit(None).cast("int").alias("priority"), none.alias("goal"))
    )
