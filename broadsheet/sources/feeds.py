"""RSS, RDF and Atom payloads to articles.

payloads: source_pos INT, payload STRING (one feed document per source)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import clean, dates, images
from broadsheet.functions.textops import decode_entities, first_filled, strip
from broadsheet.operators import filters
from broadsheet.sources import registry
from broadsheet.sources.config import option

_LINK = "array<struct<_VALUE:string,_href:string,_rel:string>>"
_FIELDS = {
    "title": "string", "link": _LINK, "guid": "struct<_VALUE:string,_isPermaLink:string>", "author": "struct<_VALUE:string,name:string>",
    "`dc:creator`": "string", "pubDate": "string", "published": "string", "`content:encoded`": "string", "content": "string",
    "summary": "string", "description": "string", "category": "array<struct<_VALUE:string,_term:string>>",
}
_ENTRY = f"struct<{','.join(f'{name}:{kind}' for name, kind in _FIELDS.items())}>"
_ONE = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items()) + ", _bad string"
_FEED = (
    f"channel struct<title:string,item:array<{_ENTRY}>>, item array<{_ENTRY}>, title string, entry array<{_ENTRY}>, "
    "_bad string"
)
_XML = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def _link(e: Column) -> Column:
    """Address of an entry: link text, else the alternate (or unqualified) link, else any link, else the guid."""
    alternate = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    guid = F.when(F.coalesce(e["guid"]["_isPermaLink"], F.lit("true")) != "false", e["guid"]["_VALUE"])
    return first_filled(
        F.try_element_at(e["link"], F.lit(1))["_VALUE"],
        F.try_element_at(alternate, F.lit(1))["_href"],
        F.try_element_at(e["link"], F.lit(1))["_href"],
        guid,
    )


def _mended(xml: Column) -> Column:
    """An entry whose stray ampersands and unknown entities are text; sections of plain data are left alone."""
    plain = F.regexp_replace(xml, "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)", "&amp;")
    return F.when(xml.contains("<![CDATA["), xml).otherwise(plain)


def _rescued(payload: Column) -> Column:
    """Entries of a feed that is no well-formed document: each complete one is read by itself."""
    found = F.regexp_extract_all(payload, F.lit(r"(?is)<(item|entry)[\s>].*?</\1\s*>"), F.lit(0))
    read = F.filter(F.transform(found, lambda x: F.from_xml(_mended(x), _ONE, _XML)), lambda e: e["_bad"].isNull())
    return F.transform(read, lambda e: e.dropFields("_bad")).cast(f"array<{_ENTRY}>")


def entries(payloads: DataFrame) -> DataFrame:
    """One row per feed with its entries: source_pos, source_title, items, broken."""
    parsed = payloads.select("source_pos", "payload", F.from_xml("payload", _FEED, _XML).alias("f"))
    broken = F.col("f._bad").isNotNull()
    whole = F.coalesce(F.col("f.channel.item"), F.col("f.entry"), F.col("f.item"), F.array().cast(f"array<{_ENTRY}>"))
    head = F.split("payload", r"(?i)<(?:item|entry)[\s>]", 2)[0]
    first_title = strip(F.regexp_extract(head, r"(?i)<title[^>]*>([^<]*)</title", 1))
    return parsed.select(
        "source_pos",
        F.when(broken, decode_entities(first_title)).otherwise(F.coalesce(F.col("f.channel.title"), F.col("f.title"), F.lit(""))).alias("source_title"),
        F.when(broken, _rescued(F.col("payload"))).otherwise(whole).alias("items"),
        broken.alias("broken"),
    )


def parse_feed(payloads: DataFrame, sources: DataFrame, global_limit: int = fv.DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """First entries of each feed as articles, title filter applied; a feed without entries is a failed run.

    Entries whose body is empty are left out; they use up a place of the limit, as do filtered titles.
    """
    feeds = entries(payloads)
    runs = feeds.select(
        "source_pos",
        (F.size("items") > 0).alias("success"),
        F.when(
            F.size("items") == 0,
            F.concat(F.lit("Failed to parse RSS feed: "), F.when(F.col("broken"), "not well-formed").otherwise("No entries found")),
        ).alias("error"),
        F.when(F.size("items") > 0, F.col("source_title")).alias("source_title"),
    )
    config = sources.select(
        "source_pos", F.coalesce(option(F.col("metadata"), "limit", "int"), F.lit(global_limit)).alias("_limit")
    )
    first = feeds.join(config, "source_pos").select(
        "source_pos", F.posexplode(F.slice("items", 1, F.greatest(F.col("_limit"), F.lit(0)))).alias("item_pos", "e")
    )
    e = F.col("e")
    summary = F.coalesce(e["content:encoded"], e["content"], e["summary"], e["description"], F.lit(""))
    link = F.coalesce(_link(e), F.lit(""))
    rows = first.select(
        "source_pos",
        "item_pos",
        F.coalesce(strip(e["title"]), F.lit("No Title")).alias("title"),
        summary.alias("content"),
        strip(link).alias("url"),
        F.coalesce(first_filled(e["author"]["name"], e["author"]["_VALUE"], e["dc:creator"]), F.lit("")).alias("author"),
        dates.normalize(strip(F.coalesce(e["pubDate"], e["published"], F.lit("")))).alias("published_date"),
        F.create_map(
            F.lit("categories"),
            F.array_join(F.transform(e["category"], lambda c: F.coalesce(c["_term"], c["_VALUE"])), ","),
        ).alias("metadata"),
    )
    return rows, runs


def summaries(rows: DataFrame) -> DataFrame:
    """Entries with their own body: images from it, empty bodies dropped."""
    kept = rows.filter(F.coalesce(F.col("content"), F.lit("")) != "")
    return registry.as_articles(kept.withColumn("images", images.extract(F.col("content"), F.col("url"))))


def page_bodies(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Body and images of the landed pages that are linked: url, body, page_images.

    A url that landed more than once counts once, with the least html in string order.
    """
    wanted = pages.join(links.distinct(), "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    url, html = F.col("url"), F.col("html")
    return wanted.select(
        "url",
        clean.main_content(html).alias("body"),
        images.merge(images.extract_cover(html, url), images.extract(html, url)).alias("page_images"),
    )


def enrich_full_text(rows: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with full_text = Y take body and images from the page behind the link; no page means no article.

    A link shared by very many articles is split by adaptive execution.
    """
    flagged = filters.with_source(rows, sources, ["full_text"])
    full = flagged.filter(F.col("full_text") == "Y").drop("full_text")
    own = flagged.filter(F.col("full_text") != "Y").drop("full_text")
    bodies = page_bodies(pages, full.select("url"))
    joined = full.drop("content", "images").join(bodies, "url")
    enriched = joined.filter(F.col("body") != "").withColumnsRenamed({"body": "content", "page_images": "images"})
    return summaries(own).unionByName(registry.as_articles(enriched))


@registry.source("rss", {"full_text": "string", "metadata.limit": "int"})
def adapter(ctx: registry.Context) -> tuple[DataFrame, DataFrame]:
    rows, runs = parse_feed(ctx.landing("rss"), ctx.sources, ctx.global_limit)
    pages = ctx.landing("pages")
    # without landed pages a full-text source has no bodies, so all its entries are dropped
    articles = enrich_full_text(rows, pages, ctx.sources) if pages is not None else summaries(
        filters.with_source(rows, ctx.sources, ["full_text"]).filter(F.col("full_text") != "Y").drop("full_text")
    )
    return filters.drop_titles(articles, ctx.sources), runs
