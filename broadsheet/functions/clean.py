"""The whole cleaning of one article body, and the body of a raw page, as Column expressions.

A body is tokenised once after the exclude rules; every later rule is a decision or a rewrite per token, and one fold
writes the result.  The expression is a narrow projection: no shuffle, no sort, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import images, rules, tree
from broadsheet.functions import markup as m
from broadsheet.functions.fold import fold_emit, let
from broadsheet.functions.textops import blank_to_null, decode_entities, strip

_REGION_TAGS = ["nav", "header", "footer", "aside"]
MAX_LINK_SHARE = 0.5


def rewrite_tag(raw: Column, name: Column) -> Column:
    """All rewrites of one opening tag: rename, style, image size, allowed attributes."""
    def styled(r: Column) -> Column:
        return let(m.filter_style(r, m.new_name(name)), sized)

    def sized(r: Column) -> Column:
        return let(m.int_dimensions(r, name), lambda x: m.filter_attrs(x, m.new_name(name)))

    plain = raw.rlike(r"^<[a-z0-9]+>\z") & ~name.isin(list(fv.TAG_RENAMES))
    return F.when(plain, raw).otherwise(let(m.rename_tag(raw, name), styled))


def _decisions(tokens: Column) -> Column:
    """Elements to cut and tags to rewrite, on tokens that already carry the link decisions."""
    gone = fv.MEDIA_TAGS + fv.ACTIVE_TAGS + ["head"]

    def one(t: Column) -> Column:
        shell = (t["kind"] == "comment") & t["raw"].rlike(r"(?i)^<(!doctype|\?)")
        act = (
            F.when(t["name"].isin(gone) | shell, tree.CUT)
            .when(t["name"].isin("html", "body"), tree.UNWRAP)
            .otherwise(t["act"])
        )
        tag = t["kind"].isin("open", "void") & (act == tree.KEEP)
        return tree.token(t, act, F.when(tag, rewrite_tag(t["out"], t["name"])).otherwise(t["out"]))

    return F.transform(tokens, lambda t: F.when(t["kind"].isin("text", "close"), t).otherwise(one(t)))


def clean_bodies(
    df: DataFrame, html: str, base: str, image_list: str | None, keep_link: str | None, exclude: str | None, out: str
) -> DataFrame:
    """Column ``out`` with the cleaned ``html``: lead image, exclude rules, links, tables, icons, tags, styles,
    attributes, nesting, emoji; the original where the result is null.

    Each stage is one projection, so that every intermediate value is computed once; there is no shuffle.
    """
    body, rule_list = F.col(html), F.col(exclude) if exclude else None
    d = df.withColumn("_led", images.insert_lead_image(body, F.col(image_list)) if image_list else body)
    if exclude:
        some = F.coalesce(F.size(rule_list) > 0, F.lit(False))
        d = d.withColumn("_ruled", F.when(some, rules.apply_rules(F.col("_led"), rule_list)).otherwise(F.col("_led")))
        d = d.withColumn("_led", F.when(some, tree.drop_empty(F.col("_ruled"))).otherwise(F.col("_ruled")))
    d = d.withColumn("_tokens", m.parse(F.col("_led")))
    d = d.withColumn("_tokens", tree.link_tokens(F.col("_tokens"), F.col(base), F.col(keep_link) if keep_link else None))
    d = d.withColumn("_tokens", tree.unwrap_tables(F.col("_tokens")))
    d = d.withColumn("_tokens", tree.cut_small_icons(F.col("_tokens")))
    d = d.withColumn("_tokens", _decisions(F.col("_tokens")))
    written = let(
        m.has_emoji(F.col("_led")),
        lambda emoji: tree.rebuild(F.col("_tokens"), close_paragraphs=True, mark_emoji=emoji),
    )
    return d.withColumn(out, F.coalesce(written, body)).drop("_led", "_ruled", "_tokens")


# --- raw pages ------------------------------------------------------------------------------------------------------
def page_title(html: Column, source_title: Column, src: Column) -> Column:
    """title tag, first h1, og:title, configured title, address: the first that is not empty."""
    no_raw = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")

    def pick(h: Column) -> Column:
        def text(c: Column) -> Column:
            return strip(decode_entities(F.regexp_replace(c, r"<[^>]*>", "")))

        og = F.try_element_at(
            F.filter(m.split_tokens(h), lambda t: (m.name_of(t) == "meta") & (m.attr(t, "property") == "og:title")),
            F.lit(1),
        )
        return F.coalesce(
            blank_to_null(text(F.regexp_extract(h, r"(?is)<title\b[^>]*>([^<]*)</title", 1))),
            blank_to_null(text(F.regexp_extract(h, r"(?is)<h1\b[^>]*>(.*?)</h1", 1))),
            F.when(h.contains("og:title"), blank_to_null(m.attr_text(og, "content"))),
            blank_to_null(source_title),
            src,
        )

    return let(no_raw, pick)


def _text_share(html: Column) -> Column:
    """Drop text runs between block tags in which more than the allowed share of the characters is link text.

    The first pass reads lengths only and writes one digit per run (1: dropped); the second copies the tokens of the other runs.
    """
    def is_boundary(t: Column) -> Column:
        return t["name"].isin(*fv.BLOCK_TAGS, *fv.TABLE_PART_TAGS, "body", "html")

    def verdict(get) -> Column:
        dense = (get("linked") > MAX_LINK_SHARE * get("total")) & (get("total") > 0)
        return F.when(dense, "1").otherwise("0")

    def measure(get, then, t):
        kind, name = t["kind"], t["name"]
        in_link = get("link")
        n = F.when(kind == "text", F.length(strip(t["raw"]))).otherwise(0)
        opened = F.when((name == "a") & (kind == "open"), True).when((name == "a") & (kind == "close"), False).otherwise(in_link)
        counted = then(F.lit(""), total=get("total") + n, linked=get("linked") + F.when(in_link, n).otherwise(0), link=opened)
        return F.when(is_boundary(t), then(verdict(get), total=F.lit(0), linked=F.lit(0), link=F.lit(False))).otherwise(counted)

    def write(verdicts: Column):
        def step(get, then, t):
            kept = F.when(F.get(verdicts, get("run")) == "1", "").otherwise(t["raw"])
            return F.when(is_boundary(t), then(t["raw"], run=get("run") + 1)).otherwise(then(kept))

        return step

    init = {"total": F.lit(0), "linked": F.lit(0), "link": F.lit(False)}

    def both(ts: Column) -> Column:
        digits = F.split(fold_emit(ts, init, measure, verdict), "")
        return let(digits, lambda v: fold_emit(ts, {"run": F.lit(0)}, write(v), lambda get: F.lit("")))

    return let(m.parse(html), both)


def _has_content(html: Column) -> Column:
    """Any visible character outside tags, or an image."""
    seen = rf"(?:^|>)(?:[{fv.SPACE_CLASS}]|&nbsp;|&#160;)*+[^<{fv.SPACE_CLASS}]"
    return html.rlike(seen) | html.rlike(r"(?i)<img[\s/>]")


def main_content(html: Column) -> Column:
    """Body of a page: from the first article (else main) tag to its last end tag, else the page without navigation
    regions and without link-dense runs.  Comments, scripts and styles never count.  '' when no text or image is left.
    """
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")

    def span(h: Column, tag: str) -> Column:
        return F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1)

    def rest(h: Column) -> Column:
        cut = tree.drop_elements(h, _REGION_TAGS + fv.ACTIVE_TAGS + ["head"])
        return let(cut, lambda c: let(_text_share(c), lambda d: tree.balance(tree.drop_empty(d))))

    def pick(h: Column) -> Column:
        main = let(span(h, "main"), lambda b: F.when(b != "", b).otherwise(F.when(h.contains("<"), rest(h)).otherwise(h)))
        body = let(span(h, "article"), lambda a: F.when(a != "", a).otherwise(main))
        return let(let(body, m.restore_images), lambda b: F.when(_has_content(b), b).otherwise(""))

    return F.when(F.coalesce(html, F.lit("")) == "", F.lit("")).otherwise(let(bare, pick))
