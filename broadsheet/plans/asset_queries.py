"""Images and emoji of an edition over whole pages; the image tags are injected into every article."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import images, markup
from broadsheet.operators import assets
from broadsheet.plans import markup_sql as m
from broadsheet.plans.catalog import q, query
from broadsheet.plans.tree_queries import FLAG, GRIN, injected, injected_sql

_IMAGES = (
    '<img src="/a{id}.png" alt="own"><img alt="all" src="https://cdn.example.net/shared.png?v=1&amp;w=2"><img src="data:image/png;base64,AA" data-src=""><img data-src="lazy{m}.jpg" src="x.gif" width="3">'
    '<img srcset="s.png 1x, /set{m}.png 2x" src="/a{id}.png"><img data-original="p.gif" src="/b{m}.png"><img src=""><img alt="none"><img class="big emoji" src="/a{id}.png">'
    '<p><img src="/a{id}.png"/></p><IMG SRC="/up{m}.png">'
)


def _chapters(spark, sf):
    return injected(spark, sf, _IMAGES).select(F.col("page_id").alias("chapter_no"), "url", "html")


def _refs(s: m.Script) -> str:
    """Image tokens with their chosen source; null for emoji images."""
    s.add("src", injected_sql(_IMAGES))
    t = m.tokens(s, "a", "src")
    filled = lambda x: f"nullif({x}, '')"
    srcset = f"coalesce({filled(m.attr('data-srcset'))}, {m.attr('srcset')})"
    last = f"list_filter(list_transform(string_split({srcset}, ','), lambda e: regexp_extract(e, '^{m.SPACE}*([^{fv.SPACE_CLASS}]+)', 1)), lambda e: e <> '')[-1]"
    lazy = ", ".join(
        "CASE WHEN " + " AND ".join([f"{m.attr(a)} <> ''", *(f"NOT contains(lower({m.attr(a)}), {q(x)})" for x in fv.PLACEHOLDER_EXTENSIONS)]) + f" THEN {m.decode(m.attr(a))} END"
        for a in fv.ASSET_IMAGE_ATTRS
    )
    emoji = f"list_contains(regexp_split_to_array({m.attr('class')}, '\\s+'), 'emoji')"
    picked = f"CASE WHEN {emoji} THEN NULL ELSE coalesce({m.decode(last)}, {lazy}, {filled(m.decode(m.attr('src')))}) END"
    return s.add("img", f"SELECT *, {emoji} AS emoji, {picked} AS src FROM {t} WHERE name = 'img' AND kind IN ('open', 'void')")


_FILE = "'image_' || left(md5(src), 12) || '.jpg'"
#: which images were fetched: about half
_FETCHED = "ascii(left(md5(src), 1)) % 2 = 0"


def _collect_sql() -> str:
    s = m.Script()
    _refs(s)
    return s.query(f"SELECT src, arg_min(url, page_id * 100000 + pos) AS referer, {_FILE} AS filename FROM img WHERE src IS NOT NULL AND NOT starts_with(src, 'data:') GROUP BY src")


@query("a7_unique_assets", _collect_sql())
def a7(spark, sf):
    return assets.collect(_chapters(spark, sf))


def _rewrite_sql() -> str:
    s = m.Script()
    _refs(s)
    gone = m.names([*fv.ASSET_IMAGE_ATTRS, "src"])
    an = "lower(regexp_extract(a, '^[^\\s=]+'))"
    stripped = lambda keep: f"array_to_string(list_transform({keep}, lambda a: ' ' || a), '')"
    inline = f"list_filter(attrs, lambda a: {an} NOT IN {m.names(fv.ASSET_IMAGE_ATTRS)})"
    placed = f"list_transform({inline}, lambda a: CASE WHEN {an} = 'src' THEN left(a, 4) || '\"images/' || {_FILE} || '\"' ELSE a END)"
    added = f"CASE WHEN {m.has('src')} THEN '' ELSE ' src=\"images/' || {_FILE} || '\"' END"
    end, head = "CASE WHEN ends_with(raw, '/>') THEN '/>' ELSE '>' END", "left(raw, 4)"
    s.add("new", f"""SELECT page_id, pos, CASE WHEN emoji THEN raw WHEN src IS NULL THEN '' WHEN starts_with(src, 'data:') THEN {head} || {stripped(inline)} || {end}
        WHEN {_FETCHED} THEN {head} || {stripped(placed)} || {added} || {end} ELSE '' END AS piece FROM img""")
    return s.query("SELECT t.page_id AS chapter_no, string_agg(coalesce(piece, raw), '' ORDER BY t.pos) AS html FROM a_t t LEFT JOIN new USING (page_id, pos) GROUP BY ALL")


@query("j5_substitute_images", _rewrite_sql())
def j5(spark, sf):
    chapters = _chapters(spark, sf)
    fetched = assets.collect(chapters).filter(F.ascii(F.left(F.md5("src"), F.lit(1))) % 2 == 0)
    return assets.rewrite(chapters, fetched, ["chapter_no"]).select("chapter_no", "html")


# --- emoji ----------------------------------------------------------------------------------------------------------
#: one emoji per page from a range of 64, a pair and a flag
_FACES = [chr(0x1F600 + k) for k in range(64)]
_OWN = f'<p>{GRIN}{GRIN} x {FLAG}</p><span class="emoji">{FLAG}</span><span class="emoji">a</span>'


def _with_emoji(spark, sf):
    p = injected(spark, sf, _OWN)
    own = F.element_at(F.lit(_FACES), (F.col("page_id") % 64 + 1).cast("int"))
    return p.withColumn("html", F.concat(F.lit('<span class="emoji">'), own, F.lit("</span>"), F.col("html")))


_EMOJI_SQL = """SELECT emoji, array_to_string(list_transform(string_split(emoji, ''), lambda c: lower(to_hex(unicode(c)))), '-') AS codepoint FROM
    (SELECT DISTINCT unnest(regexp_extract_all(html, '<span class="emoji">([^<]*)</span>', 1)) AS emoji FROM e)"""


def _emoji_pages(s: m.Script) -> None:
    s.add("src", injected_sql(_OWN))
    s.add("e", "SELECT page_id, url, '<span class=\"emoji\">' || chr(CAST(128512 + page_id % 64 AS INT)) || '</span>' || html AS html FROM src")


def _unique_sql() -> str:
    s = m.Script()
    _emoji_pages(s)
    return s.query(_EMOJI_SQL)


@query("a6_unique_emoji", _unique_sql())
def a6(spark, sf):
    return assets.unique_emoji(_with_emoji(spark, sf), "html")


def _codes_sql() -> str:
    s = m.Script()
    _emoji_pages(s)
    code = "array_to_string(list_transform(string_split(x, ''), lambda c: lower(to_hex(unicode(c)))), '-')"
    return s.query(f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<span class="emoji">([^<]*)</span>', 1), lambda x: {code}), ' ') AS codes FROM e""")


@query("f12_emoji_codepoint", _codes_sql())
def f12(spark, sf):
    found = markup.find_emoji(F.col("html"))
    return _with_emoji(spark, sf).select("page_id", F.array_join(F.transform(found, markup.emoji_codepoint), " ").alias("codes"))


# --- choice of a source ---------------------------------------------------------------------------------------------
def _pick_sql() -> str:
    s = m.Script()
    _refs(s)
    return s.query("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS pos, src FROM img WHERE true")


@query("x25_pick_source", _pick_sql())
def x25(spark, sf):
    tags = F.posexplode(F.transform(images.image_tags(F.col("html")), images.asset_src)).alias("pos", "src")
    return injected(spark, sf, _IMAGES).select("page_id", tags)


_SETS = '<img srcset="a{id}.png 1x,b{m}.png 2x"><img srcset=" c.png , d{id}.png  640w ,  "><img srcset=""><img srcset=",,"><img srcset="https://e.example.org/x{m}.png">'


def _sets_sql() -> str:
    s = m.Script()
    s.add("src", injected_sql(_SETS))
    t = m.tokens(s, "a", "src")
    entry = f"regexp_extract(e, '^{m.SPACE}*([^{fv.SPACE_CLASS}]+)', 1)"
    return s.query(f"""SELECT page_id, string_agg(coalesce(list_filter(list_transform(string_split({m.attr('srcset')}, ','), lambda e: {entry}), lambda e: e <> '')[-1], '-'), ' ' ORDER BY pos) AS picked
        FROM {t} WHERE name = 'img' GROUP BY page_id""")


@query("f10_srcset_last", _sets_sql())
def f10(spark, sf):
    tags = images.image_tags(F.col("html"))
    last = F.transform(tags, lambda t: F.coalesce(images.srcset_last(markup.attr(t, "srcset")), F.lit("-")))
    return injected(spark, sf, _SETS).select("page_id", F.array_join(last, " ").alias("picked"))
