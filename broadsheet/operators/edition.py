"""Edition tables: sections, chapters, table of contents, reading order, rendered lines.

Sections keep (source_pos, priority) order; chapters are numbered across the edition.  Listings are emitted as ordered
rows or bounded parts, never collected into one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import markup, urls
from broadsheet.functions.textops import blank_to_null, escape
from broadsheet.operators import numbering, stats

PART_ENTRIES = 512


def is_flat() -> Column:
    return F.col("type").isin(fv.FLAT_TYPES)


def has_new_content(articles: DataFrame, runs: DataFrame) -> bool:
    """Whether a successful source has an article."""
    good = runs.filter(F.col("success")).select("source_pos")
    return not articles.select("source_pos").join(good, "source_pos", "left_semi").isEmpty()


def ordered_sources(sources: DataFrame) -> DataFrame:
    """Sources by descending priority, configuration order among equals."""
    return sources.orderBy(F.desc("priority"), "source_pos")


def section_title() -> Column:
    """Configured title; else feed title or address for feeds, first article for pages, address for the rest."""
    by_type = F.when(
        F.col("type") == "rss", F.coalesce(blank_to_null(F.col("source_title")), F.col("src"))
    ).when(F.col("type") == "web", F.col("first_title"))
    return F.coalesce(blank_to_null(F.col("title")), by_type, F.col("src"))


def sections(articles: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Successful sources with articles: section_no, source_pos, type, section_title, n_articles, first_chapter."""
    counted = articles.groupBy("source_pos").agg(
        F.count(F.lit(1)).alias("n_articles"), F.min_by("title", "item_pos").alias("first_title")
    )
    kept = (
        runs.filter(F.col("success"))
        .select("source_pos", "source_title")
        .join(sources.select("source_pos", "type", "src", "title", "priority"), "source_pos")
        .join(counted, "source_pos")
    )
    order = W.orderBy(F.desc("priority"), "source_pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return kept.select(
        (F.row_number().over(order) - 1).alias("section_no"),
        "source_pos",
        "type",
        section_title().alias("section_title"),
        "n_articles",
        F.coalesce(F.sum("n_articles").over(before), F.lit(0)).alias("first_chapter"),
    )


def number_chapters(articles: DataFrame, section_table: DataFrame, width: int = numbering.WIDTH) -> DataFrame:
    """Articles with section_no and chapter_no (0-based across the edition)."""
    # only row keys are ranked; bodies move once, on the unique key
    places = section_table.select("source_pos", "section_no", "first_chapter")
    keys = articles.select("source_pos", "item_pos").join(places, "source_pos")
    ranked = numbering.running_number(keys, ["section_no"], [], "item_pos", "_rank", width)
    numbers = ranked.select("source_pos", "item_pos", "section_no", (F.col("first_chapter") + F.col("_rank")).alias("chapter_no"))
    return articles.join(numbers, ["source_pos", "item_pos"])


def chapter_file(n: Column) -> Column:
    return F.concat(F.lit("chapter_"), n.cast("string"), F.lit(".xhtml"))


def divider_file(n: Column) -> Column:
    return F.concat(F.lit("divider_"), n.cast("string"), F.lit(".xhtml"))


def _uid(kind: str, n: Column) -> Column:
    return F.concat(F.lit(kind + "_"), n.cast("string"))


def section_back_link(n_section: Column, n_chapter: Column) -> Column:
    """Contents entry a section divider points back to."""
    return F.when(is_flat(), F.concat(F.lit("toc_chapter_"), n_chapter.cast("string"))).otherwise(
        F.concat(F.lit("toc_section_"), n_section.cast("string"))
    )


def toc(section_table: DataFrame, chapters: DataFrame) -> DataFrame:
    """Contents entries ordered by (section_no, level, chapter_no); the summary entry comes last."""
    heads = section_table.select(
        "section_no",
        F.lit(1).alias("level"),
        F.when(is_flat(), F.col("first_chapter")).alias("chapter_no"),
        F.when(is_flat(), chapter_file(F.col("first_chapter"))).otherwise(divider_file(F.col("section_no"))).alias("href"),
        F.when(is_flat(), _uid("chapter", F.col("first_chapter"))).otherwise(_uid("section", F.col("section_no"))).alias("uid"),
        F.col("section_title").alias("title"),
    )
    nested = section_table.filter(~is_flat()).select("section_no")
    entries = chapters.join(nested, "section_no", "left_semi").select(
        "section_no",
        F.lit(2).alias("level"),
        "chapter_no",
        chapter_file(F.col("chapter_no")).alias("href"),
        _uid("chapter", F.col("chapter_no")).alias("uid"),
        "title",
    )
    last = section_table.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n").cast("int").alias("section_no"),
        F.lit(1).alias("level"),
        F.lit(None).cast("bigint").alias("chapter_no"),
        F.lit("summary.xhtml").alias("href"),
        F.lit("summary").alias("uid"),
        F.lit(fv.SUMMARY_TITLE).alias("title"),
    )
    return heads.unionByName(entries).unionByName(last)


def back_links(section_table: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every page with the contents entry its back link points at."""
    dividers = section_table.select(
        divider_file(F.col("section_no")).alias("file_name"),
        section_back_link(F.col("section_no"), F.col("first_chapter")).alias("target"),
    )
    pages = chapters.select(
        chapter_file(F.col("chapter_no")).alias("file_name"), F.concat(F.lit("toc_"), _uid("chapter", F.col("chapter_no"))).alias("target")
    )
    return dividers.unionByName(pages)


def dangling_links(toc_table: DataFrame, links: DataFrame) -> DataFrame:
    """Back links whose contents entry does not exist."""
    ids = toc_table.select(F.concat(F.lit("toc_"), F.col("uid")).alias("target"))
    return links.join(ids, "target", "left_anti")


def spine(section_table: DataFrame, chapters: DataFrame) -> DataFrame:
    """Reading order: contents, then divider and chapters of each section, then the summary.

    Ordered by (section_no, kind, chapter_no).
    """
    empty = F.lit(None).cast("bigint")
    one = section_table.agg(F.count(F.lit(1)).cast("int").alias("n"))
    first = one.select(F.lit(-1).alias("section_no"), F.lit(0).alias("kind"), empty.alias("chapter_no"), F.lit("contents.xhtml").alias("file_name"))
    dividers = section_table.select("section_no", F.lit(1).alias("kind"), empty.alias("chapter_no"), divider_file(F.col("section_no")).alias("file_name"))
    pages = chapters.select("section_no", F.lit(2).alias("kind"), "chapter_no", chapter_file(F.col("chapter_no")).alias("file_name"))
    last = one.select(F.col("n").alias("section_no"), F.lit(3).alias("kind"), empty.alias("chapter_no"), F.lit("summary.xhtml").alias("file_name"))
    return first.unionByName(dividers).unionByName(pages).unionByName(last)


def section_index(chapters: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Chapter titles and files of a section, in parts of at most ``part_entries`` chapters."""
    return (
        chapters.groupBy("section_no", F.floor(F.col("chapter_no") / part_entries).alias("part_no"))
        .agg(F.sort_array(F.collect_list(F.struct("chapter_no", "title"))).alias("entries"))
        .select(
            "section_no",
            "part_no",
            F.transform("entries", lambda e: F.struct(e["chapter_no"].alias("chapter_no"), e["title"].alias("title"),
                                                      chapter_file(e["chapter_no"]).alias("file_name"))).alias("entries"),
        )
    )


# --- rendering ------------------------------------------------------------------------------------------------------
def back_link_html(target: Column) -> Column:
    return F.concat(
        F.lit('<p class="toc-link"><a href="contents.xhtml#'), target, F.lit(f'">{fv.BACK_TO_CONTENTS}</a></p>')
    )


def _page(title: Column, *body: Column) -> Column:
    """A page around its body: escaped title in head and heading."""
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="zh" xml:lang="zh"><head><title>'),
        title,
        F.lit('</title><link rel="stylesheet" type="text/css" href="style/default.css"/></head><body><h1>'),
        title,
        F.lit("</h1>"),
        *body,
        F.lit("</body></html>"),
    )


def render_chapters(chapters: DataFrame) -> DataFrame:
    """Chapter pages: title, back link, author and date when given, body, link to an http(s) source."""
    def line(value: Column, open_: str, close: str) -> Column:
        return F.when(value != "", F.concat(F.lit(open_), value, F.lit(close))).otherwise("")

    link = escape(F.col("url"))
    html = _page(
        escape(F.coalesce(F.col("title"), F.lit(""))),
        back_link_html(F.concat(F.lit("toc_chapter_"), F.col("chapter_no").cast("string"))),
        line(escape(F.col("author")), "<p class='author'>作者: ", "</p>"),
        line(F.col("published_date"), "<p class='date'>日期: ", "</p>"),
        F.lit("<div class='content'>"),
        markup.emoji_to_images(F.coalesce(F.col("content"), F.lit(""))),
        F.lit("</div>"),
        F.when(
            urls.is_web(F.col("url")),
            F.concat(F.lit("<p class='link'>原文链接: <a href='"), link, F.lit("'>"), link, F.lit("</a></p>")),
        ).otherwise(""),
    )
    return chapters.select("section_no", "chapter_no", "title", "url", chapter_file(F.col("chapter_no")).alias("file_name"), html.alias("html"))


def dividers(section_table: DataFrame, chapters: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Section divider pages: a head row (part -1), list parts of bounded size, and an end row, ordered by part_no.

    The page of a section is its rows joined in order.
    """
    title = escape(F.col("section_title"))
    head = section_table.select(
        "section_no",
        F.lit(-1).cast("bigint").alias("part_no"),
        F.concat(
            F.lit("<h1>"), title, F.lit("</h1>"),
            back_link_html(section_back_link(F.col("section_no"), F.col("first_chapter"))), F.lit('<div id="toc"><ol>'),
        ).alias("html"),
    )

    def entry(e: Column) -> Column:
        return F.concat(
            F.lit('<li><a class="article-link" href="'), e["file_name"], F.lit('">'), escape(e["title"]), F.lit("</a></li>")
        )

    parts = section_index(chapters, part_entries).select(
        "section_no", "part_no", F.array_join(F.transform("entries", entry), "").alias("html")
    )
    end = section_table.select(
        "section_no", F.lit(9223372036854775807).alias("part_no"), F.lit("</ol></div>").alias("html")
    )
    return head.unionByName(parts).unionByName(end)


def render_nav(toc_table: DataFrame, section_table: DataFrame) -> DataFrame:
    """Navigation list as ordered lines: (section_no, level, chapter_no, html); level 3 closes a nested list."""
    flat = (F.col("level") == 1) & (F.col("uid").startswith("chapter_") | (F.col("uid") == "summary"))
    anchor = F.concat(
        F.lit('<li id="toc_'), F.col("uid"), F.lit('"><a class="'),
        F.when(F.col("level") == 1, "section-link").otherwise("article-link"),
        F.lit('" href="'), F.col("href"), F.lit('">'), escape(F.coalesce(F.col("title"), F.lit(""))), F.lit("</a>"),
        F.when(flat | (F.col("level") == 2), "</li>").otherwise("<ol>"),
    )
    lines = toc_table.select("section_no", "level", "chapter_no", anchor.alias("html"))
    ends = section_table.filter(~is_flat()).select(
        "section_no", F.lit(3).alias("level"), F.lit(None).cast("bigint").alias("chapter_no"), F.lit("</ol></li>").alias("html")
    )
    return lines.unionByName(ends)


def render_summary(runs: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Summary page as ordered lines ``(block, source_pos, html)``: totals, one line per source, errors."""
    def stat(label: str, value: Column) -> Column:
        return F.concat(F.lit(f'<div class="stat-item"><span class="stat-label">{label}：</span>'), value.cast("string"), F.lit("</div>"))

    totals = stats.run_summary(runs, articles).select(
        F.lit(1).alias("block"),
        F.lit(-1).alias("source_pos"),
        F.concat(
            stat("数据源总数", F.col("sources")), stat("成功抓取", F.col("succeeded")),
            stat("抓取失败", F.col("failed")), stat("新增文章", F.col("articles")),
        ).alias("html"),
    )
    detail = stats.source_summary(runs, articles, sources).select(
        F.lit(2).alias("block"),
        "source_pos",
        F.concat(
            F.lit('<li class="source-item"><span class="stat-label">['), F.col("type"), F.lit("] "), escape(F.col("name")),
            F.lit("</span>："),
            F.when(F.col("success"), F.concat(F.lit('<span class="tag-success">成功</span>，新增 '), F.col("new_articles").cast("string"), F.lit(" 篇文章</li>")))
            .otherwise(F.concat(F.lit('<span class="tag-failed">失败</span> ('), escape(F.col("error")), F.lit(")</li>"))),
        ).alias("html"),
    )
    errors = stats.error_log(runs, sources).select(
        F.lit(3).alias("block"), "source_pos", F.concat(F.lit("<li>"), escape(F.col("line")), F.lit("</li>")).alias("html")
    )
    return totals.unionByName(detail).unionByName(errors)
