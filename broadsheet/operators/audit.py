"""Violation counts of the output rules over a table of article bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import markup as m
from broadsheet.functions import urls
from broadsheet.functions.fold import let
from broadsheet.functions.textops import html_to_text, strip

RULES = [
    "active_or_media_tag", "legacy_tag", "disallowed_attribute", "fractional_size", "bad_href", "block_in_paragraph",
    "unclosed_tag", "empty_body", "remote_image",
]


def _count(tokens: Column, test) -> Column:
    return F.size(F.filter(tokens, test))


def _blocks_in_paragraphs(tokens: Column) -> Column:
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))

    def walk(acc: Column, t: Column) -> Column:
        p = F.when((t["name"] == "p") & (t["kind"] == "open"), 1).when((t["name"] == "p") & (t["kind"] == "close"), -1).otherwise(0)
        bad = t["kind"].isin("open", "void") & t["name"].isin(fv.BLOCK_TAGS) & (acc["depth"] > 0)
        return F.struct(
            F.greatest(acc["depth"] + p, F.lit(0)).alias("depth"), (acc["n"] + bad.cast("int")).alias("n")
        )

    return F.aggregate(tokens, start, walk, lambda acc: acc["n"])


def _bad_href(t: Column) -> Column:
    href = strip(m.attr_text(t["raw"], "href"))
    fine = href.startswith("#") | (urls.scheme(href).isin(fv.LINK_SCHEMES) & ~href.contains(" "))
    return (t["name"] == "a") & (t["kind"] == "open") & m.has_attr(t["raw"], "href") & ~fine


def counts(html: Column) -> Column:
    """Violations of one body, a struct with one field per rule."""
    def measure(ts: Column) -> Column:
        tag = lambda t: t["kind"].isin("open", "void")
        img = lambda t: (t["name"] == "img") & tag(t)
        odd = lambda t, which: m.has_attr(t["raw"], which) & ~m.attr(t["raw"], which).rlike(r"^-?[0-9]+\z")
        values = [
            _count(ts, lambda t: (tag(t) | (t["kind"] == "raw")) & t["name"].isin(fv.MEDIA_TAGS + fv.ACTIVE_TAGS)),
            _count(ts, lambda t: t["name"].isin(list(fv.TAG_RENAMES)) & tag(t)),
            _count(ts, lambda t: tag(t) & F.exists(m.attr_list(t["raw"]), lambda a: ~a["name"].isin(fv.ALLOWED_ATTRS))),
            _count(ts, lambda t: img(t) & (odd(t, "width") | odd(t, "height"))),
            _count(ts, _bad_href),
            _blocks_in_paragraphs(ts),
            F.abs(_count(ts, lambda t: t["kind"] == "open") - _count(ts, lambda t: t["kind"] == "close")),
            F.when((html_to_text(html) == "") & ~html.rlike(r"(?i)<img[\s/>]"), 1).otherwise(0),
            _count(ts, lambda t: img(t) & m.attr(t["raw"], "src").rlike(r"^(https?:)?//")),
        ]
        return F.struct(*[v.cast("bigint").alias(r) for r, v in zip(RULES, values)])

    return let(m.parse(html), measure)


def violations(articles: DataFrame, html: str) -> DataFrame:
    """One row per rule with its number of violations."""
    measured = articles.select(counts(F.col(html)).alias("c"))
    sums = measured.agg(*[F.sum(F.col(f"c.{r}")).alias(r) for r in RULES])
    return sums.unpivot([], RULES, "rule", "n").withColumn("n", F.coalesce("n", F.lit(0)))
