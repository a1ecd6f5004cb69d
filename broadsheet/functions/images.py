"""Image references in markup: extraction, choice of candidate, lead image, local file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import markup as m
from broadsheet.functions import urls
from broadsheet.functions.fold import let
from broadsheet.functions.textops import SPACE, blank_to_null, first_filled


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def srcset_last(srcset: Column) -> Column:
    """Address of the last candidate of a srcset; null when there is none."""
    entries = F.transform(F.split(srcset, ","), lambda e: F.regexp_extract(e, rf"^{SPACE}*([^{fv.SPACE_CLASS}]+)", 1))
    return F.try_element_at(F.filter(entries, lambda e: e != ""), F.lit(-1))


def _candidate(raw: Column, lazy_attrs: list[str]) -> Column:
    """Best source of one image tag: srcset, then lazy attributes without placeholder extensions, then src."""
    srcset = first_filled(m.attr_text(raw, "data-srcset"), m.attr_text(raw, "srcset"))

    def lazy(name: str) -> Column:
        value = m.attr_text(raw, name)
        placeholder = F.lit(False)
        for ext in fv.PLACEHOLDER_EXTENSIONS:
            placeholder = placeholder | F.lower(value).contains(ext)
        return F.when((value != "") & ~placeholder, value)

    bare = blank_to_null(m.attr_text(raw, "src"))
    rich = F.coalesce(srcset_last(srcset), *[lazy(a) for a in lazy_attrs], bare)
    only_src = ~raw.rlike(r"(?i)srcset|data-|\b(file|zoom-target|original)\b")
    return F.when(only_src, bare).otherwise(rich)


def image_tags(html: Column) -> Column:
    """Image tags of the markup in order."""
    return F.filter(m.split_tokens(html), lambda t: t.rlike(r"(?i)^<img[\s/>]"))


def extract(html: Column, base: Column) -> Column:
    """Distinct absolute image addresses in order; inline data is skipped."""
    picked = F.transform(image_tags(html), lambda t: _candidate(t, fv.LAZY_IMAGE_ATTRS))
    wanted = F.filter(picked, lambda s: s.isNotNull() & ~s.startswith("data:image"))
    found = let(
        urls.base_parts(base), lambda b: F.array_distinct(F.transform(wanted, lambda s: urls.resolve_in(s, b)))
    )
    return F.when(html.rlike(r"(?i)<img"), found).otherwise(_no_strings())


def extract_raw(html: Column) -> Column:
    """src values as they stand, repeats included (mail bodies)."""
    found = F.filter(F.transform(image_tags(html), lambda t: m.attr_text(t, "src")), lambda s: s != "")
    return F.when(html.rlike(r"(?i)<img"), found).otherwise(_no_strings())


def extract_cover(html: Column, base: Column) -> Column:
    """Cover image addresses: first og:image, first twitter:image, first link of relation image_src."""
    tags = F.filter(m.split_tokens(html), lambda t: t.rlike(r"(?i)^<(meta|link)[\s/]"))

    def pick(ts: Column) -> Column:
        def first(test) -> Column:
            return F.try_element_at(F.filter(ts, test), F.lit(1))

        og = first(lambda t: (m.name_of(t) == "meta") & (m.attr(t, "property") == "og:image"))
        twitter = first(lambda t: (m.name_of(t) == "meta") & (m.attr(t, "name") == "twitter:image"))
        link = first(lambda t: (m.name_of(t) == "link") & F.array_contains(F.split(m.attr(t, "rel"), r"\s+"), "image_src"))
        raw = F.array(
            m.attr_text(og, "content"),
            m.attr_text(twitter, "content"),
            first_filled(m.attr_text(link, "href"), m.attr_text(link, "src")),
        )
        wanted = F.filter(raw, lambda u: u.isNotNull() & (u != "") & ~u.startswith("data:"))
        return F.array_distinct(F.transform(wanted, lambda u: urls.resolve(u, base)))

    return F.when(html.rlike(r"(?i)(og|twitter):image|image_src"), let(tags, pick)).otherwise(_no_strings())


def merge(cover: Column, body: Column) -> Column:
    """Cover images, then body images not yet listed."""
    return F.array_union(cover, body)


def asset_src(raw: Column) -> Column:
    """Source an image tag is stored under; null for emoji images."""
    is_emoji = F.array_contains(F.split(m.attr(raw, "class"), r"\s+"), "emoji")
    return F.when(~is_emoji, _candidate(raw, fv.ASSET_IMAGE_ATTRS))


def asset_filename(src: Column) -> Column:
    return F.concat(F.lit("image_"), F.left(F.md5(src.cast("binary")), F.lit(12)), F.lit(".jpg"))


def insert_lead_image(html: Column, images: Column) -> Column:
    """Put the first listed image in front unless an image of the body already names it."""
    srcs = F.transform(image_tags(html), lambda t: first_filled(m.attr_text(t, "src"), m.attr_text(t, "data-src")))

    def place(lead: Column) -> Column:
        shown = F.exists(
            srcs, lambda s: F.coalesce((s == lead) | s.contains(lead) | lead.contains(s), F.lit(False))
        )
        written = F.replace(F.replace(lead, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        tag = F.concat(F.lit('<p><img src="'), written, F.lit('" alt="Lead Image"></p>'))
        head = F.regexp_extract(html, r"(?is)^.*?<body[^>]*>", 0)
        inside = F.concat(head, tag, F.substring(html, F.length(head) + 1, F.length(html)))
        placed = F.when(html.rlike(r"(?i)<body[\s>]"), inside).otherwise(F.concat(tag, html))
        return F.when((html != "") & lead.isNotNull() & ~shown, placed).otherwise(html)

    return let(F.try_element_at(images, F.lit(1)), place)
