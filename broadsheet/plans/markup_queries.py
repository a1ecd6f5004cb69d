"""Markup operators over whole pages; the markup they act on is injected from page_id on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import images, markup, rules, urls
from broadsheet.plans.catalog import q, query, suffix_sql, suffixed, table
from broadsheet.plans.scalar_queries import _DIR, _ROOT

_IMAGES = '<img src="/i{id}.png"><img data-src="b{m}.jpg" src="x.gif"><img src="data:image/png;base64,AA"><img srcset="s.png 1x, /i{id}.png 2x"><img src="c{m}.png">'
_FOUND_SQL = f"[{_ROOT} || '/i' || page_id || '.png', {_DIR} || 'b' || page_id % 64 || '.jpg', {_DIR} || 'c' || page_id % 64 || '.png']"


@query("x2_extract_images", f"SELECT page_id, array_to_string({_FOUND_SQL}, '|') AS images FROM pages")
def x2(spark, sf):
    p = suffixed(spark, sf, _IMAGES)
    return p.select("page_id", F.array_join(images.extract(F.col("html"), F.col("url")), "|").alias("images"))


@query("x2m_extract_raw", "SELECT page_id, '/i' || page_id || '.png|x.gif|data:image/png;base64,AA|c' || page_id % 64 || '.png' AS images FROM pages")
def x2m(spark, sf):
    return suffixed(spark, sf, _IMAGES).select("page_id", F.array_join(images.extract_raw(F.col("html")), "|").alias("images"))


_COVER = (
    '<meta property="og:image" content="https://cdn.example.net/{id}.png"><meta property="og:image" content="https://cdn.example.net/no.png">'
    '<meta name="twitter:image" content="//cdn.example.net/t{m}.png"><link rel="icon image_src" href="/l{id}.png">'
)
_COVER_SQL = (
    "['https://cdn.example.net/' || page_id || '.png', regexp_extract(url, '^[^/]*', 0) || '//cdn.example.net/t' || page_id % 64 || '.png', "
    f"{_ROOT} || '/l' || page_id || '.png']"
)


@query("x3_extract_cover", f"SELECT page_id, array_to_string({_COVER_SQL}, '|') AS covers FROM pages")
def x3(spark, sf):
    return suffixed(spark, sf, _COVER).select("page_id", F.array_join(images.extract_cover(F.col("html"), F.col("url")), "|").alias("covers"))


@query(
    "u2_merge_images",
    f"SELECT page_id, array_to_string(list_concat([{_ROOT} || '/i' || page_id || '.png'], list_filter({_FOUND_SQL}, lambda x: x <> {_ROOT} || '/i' || page_id || '.png')), '|') AS images FROM pages",
)
def u2(spark, sf):
    p = suffixed(spark, sf, _IMAGES)
    cover = F.array(urls.resolve(F.concat(F.lit("/i"), F.col("page_id").cast("string"), F.lit(".png")), F.col("url")))
    return p.select("page_id", F.array_join(images.merge(cover, images.extract(F.col("html"), F.col("url"))), "|").alias("images"))


@query("x5_lead_image", "SELECT page_id, replace(html, '<body>', '<body><p><img src=\"https://cdn.example.net/a?i=' || page_id || '&amp;b=1\" alt=\"Lead Image\"></p>') AS led FROM pages")
def x5(spark, sf):
    lead = F.concat(F.lit("https://cdn.example.net/a?i="), F.col("page_id").cast("string"), F.lit("&b=1"))
    return table(spark, sf, "pages").select("page_id", images.insert_lead_image(F.col("html"), F.array(lead)).alias("led"))


@query("x8_delete_exact", "SELECT page_id, replace(html, '<p>', '') AS cut FROM pages")
def x8(spark, sf):
    return table(spark, sf, "pages").select("page_id", rules.delete_exact(F.col("html"), F.lit("<p>")).alias("cut"))


@query("x4_restore_images", f"SELECT page_id, html || replace(replace({suffix_sql('<graphic src=' + chr(34) + '{id}.png' + chr(34) + '>x</graphic>')}, '<graphic', '<img'), '</graphic', '</img') AS html FROM pages")
def x4(spark, sf):
    p = suffixed(spark, sf, '<graphic src="{id}.png">x</graphic>')
    return p.select("page_id", markup.restore_images(F.col("html")).alias("html"))


@query("x11_unwrap_links", "SELECT page_id, regexp_replace(html, '</?a(\\s[^>]*)?>', '', 'g') || page_id AS html FROM pages")
def x11(spark, sf):
    return suffixed(spark, sf, '<a href="/x">{id}</a>').select("page_id", markup.unwrap_links(F.col("html")).alias("html"))


@query(
    "x0_tokens",
    "SELECT page_id, len(regexp_extract_all(html, " + q("(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<[a-z/!?][^>]*>|[^<]+|<") + ")) AS n_tokens, md5(html) AS joined FROM pages",
)
def x0(spark, sf):
    tokens = markup.split_tokens(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(markup.join_tokens(tokens)).alias("joined"))


_EMOJI = "\U0001f600"


@query("x23_mark_emoji", f"SELECT page_id, html || page_id || '<span class=\"emoji\">{_EMOJI}</span>' AS html FROM pages")
def x23(spark, sf):
    return suffixed(spark, sf, "{id}" + _EMOJI).select("page_id", markup.wrap_emoji(F.col("html")).alias("html"))
