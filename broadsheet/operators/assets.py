"""Images and emoji of an edition.

chapters: section_no, chapter_no, url, html (or content)
assets: src, filename (images that were fetched)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import images
from broadsheet.functions import markup as m
from broadsheet.functions.fold import let


def image_refs(chapters: DataFrame, keys: list[str], html: str) -> DataFrame:
    """One row per image tag with a source that is not inline data: keys, pos, src."""
    tags = chapters.filter(F.col(html).rlike(r"(?i)<img[\s/>]")).select(
        *keys, F.posexplode(F.transform(images.image_tags(F.col(html)), images.asset_src)).alias("pos", "src")
    )
    return tags.filter(F.col("src").isNotNull() & ~F.col("src").startswith("data:"))


def collect(chapters: DataFrame, html: str = "html") -> DataFrame:
    """Distinct sources with file name and the address of the first chapter that shows them (pre-aggregated)."""
    refs = image_refs(chapters, ["chapter_no", "url"], html)
    return refs.groupBy("src").agg(F.min_by("url", F.struct("chapter_no", "pos")).alias("referer")).select(
        "src", "referer", images.asset_filename(F.col("src")).alias("filename")
    )


def _local_tag(raw: Column, local: Column) -> Column:
    """One image tag with its file in place of the remote addresses; '' without a file; inline data is kept."""
    def stripped() -> Column:
        tag = raw
        for name in fv.ASSET_IMAGE_ATTRS:
            tag = m.drop_attr(tag, name)
        return tag

    def decide(src: Column) -> Column:
        file = local[src]
        return (
            F.when(m.attr(raw, "class").rlike(r"(^|\s)emoji(\s|\z)"), raw)
            .when(src.isNull(), "")
            .when(src.startswith("data:"), stripped())
            .when(file.isNull(), "")
            .otherwise(let(stripped(), lambda t: m.set_attr(t, "src", F.concat(F.lit("images/"), file))))
        )

    return let(images.asset_src(raw), decide)


def rewrite(
    chapters: DataFrame, assets: DataFrame, keys: list[str], html: str = "html"
) -> DataFrame:
    """Chapters with every image tag pointing at its local file; tags without a file are dropped.

    Each chapter asks once per distinct source.  A source shown by very many chapters is split by adaptive execution.
    """
    wanted = image_refs(chapters, keys, html).select(*keys, "src").distinct()
    found = wanted.join(assets.select("src", "filename"), "src")
    local = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("src", "filename"))).alias("_local"))
    none = F.create_map().cast("map<string,string>")
    body = F.col(html)
    # the array is tokenised only for chapters that have images
    rewritten = F.when(
        body.rlike(r"(?i)<img[\s/>]"),
        m.map_tokens(
            body,
            lambda t: F.when(t.rlike(r"(?i)^<img[\s/>]"), _local_tag(t, F.col("_local"))).otherwise(t),
        ),
    ).otherwise(body)
    joined = chapters.join(local, keys, "left").withColumn("_local", F.coalesce("_local", none))
    return joined.withColumn(html, rewritten).drop("_local")


def unique_emoji(articles: DataFrame, html: str) -> DataFrame:
    """Distinct marked emoji with their code point names."""
    found = articles.select(F.explode(m.find_emoji(F.col(html))).alias("emoji")).distinct()
    return found.select("emoji", m.emoji_codepoint(F.col("emoji")).alias("codepoint"))
