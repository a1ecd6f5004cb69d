"""Exclude rules: cut before a keyword, cut after a keyword, delete an exact string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import markup as m
from broadsheet.functions import tree
from broadsheet.functions.fold import let
from broadsheet.functions.textops import strip

RULE_TYPE = "array<struct<type:string,value:string>>"


def _open_elements(tokens: Column) -> Column:
    """Elements still open after the tokens, as ``struct<names, raws>`` arrays."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("names"), none.alias("raws"))

    def walk(acc: Column, t: Column) -> Column:
        pushed = F.struct(
            F.array_append(acc["names"], t["name"]).alias("names"), F.array_append(acc["raws"], t["raw"]).alias("raws")
        )

        def popped(k: Column) -> Column:
            return F.when(
                k > 0, F.struct(F.slice(acc["names"], 1, k - 1).alias("names"), F.slice(acc["raws"], 1, k - 1).alias("raws"))
            ).otherwise(acc)

        return F.when(t["kind"] == "open", pushed).otherwise(let(tree.last_index(acc["names"], t["name"]), popped))

    return F.aggregate(F.filter(tokens, lambda t: t["kind"].isin("open", "close")), start, walk)


def _raws(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["raw"]), "")


def _hits(tokens: Column, keyword: Column) -> Column:
    return F.transform(tokens, lambda t: (t["kind"] == "text") & t["raw"].contains(keyword))


def _source_form(html: Column, keyword: Column) -> Column:
    """The keyword as it is written in the source when it holds special characters."""
    escaped = F.replace(F.replace(F.replace(keyword, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(html.contains(escaped), escaped).otherwise(keyword)


def _on_hit(html: Column, keyword: Column, from_end: bool, cut: Callable[[Column, Column, Column], Column]) -> Column:
    def with_keyword(kw: Column) -> Column:
        def with_tokens(ts: Column) -> Column:
            hits = _hits(ts, kw)
            back = F.array_position(F.reverse(hits), True).cast("int")
            at = F.when(back > 0, F.size(ts) - back + 1).otherwise(0) if from_end else F.array_position(hits, True).cast("int")
            return let(at, lambda i: F.when(i > 0, cut(ts, i, kw)).otherwise(html))

        return let(m.parse(html), with_tokens)

    usable = (keyword != "") & html.isNotNull()
    return F.when(usable, let(_source_form(html, keyword), lambda k: F.when(html.contains(k), with_keyword(k)).otherwise(html))).otherwise(html)


def cut_start(html: Column, keyword: Column) -> Column:
    """Delete from the beginning through the first text token holding the keyword; open ancestors stay."""

    def cut(ts: Column, i: Column, kw: Column) -> Column:
        text = F.element_at(ts, i)["raw"]
        rest = F.substring(text, F.position(kw, text) + F.length(kw), F.length(text))
        ancestors = _open_elements(F.slice(ts, 1, i - 1))["raws"]
        return F.concat(F.array_join(ancestors, ""), rest, _raws(F.slice(ts, i + 1, F.size(ts))))

    return _on_hit(html, keyword, False, cut)


def cut_end(html: Column, keyword: Column) -> Column:
    """Delete from the last occurrence in the last text token holding the keyword to the end; ancestors are closed."""

    def cut(ts: Column, i: Column, kw: Column) -> Column:
        text = F.element_at(ts, i)["raw"]
        after = F.position(F.reverse(kw), F.reverse(text)) - 1
        head = F.left(text, F.length(text) - after - F.length(kw))
        ancestors = _open_elements(F.slice(ts, 1, i - 1))["names"]
        ends = F.transform(F.reverse(ancestors), lambda n: F.concat(F.lit("</"), n, F.lit(">")))
        return F.concat(_raws(F.slice(ts, 1, i - 1)), head, F.array_join(ends, ""))

    return _on_hit(html, keyword, True, cut)


def delete_exact(html: Column, value: Column) -> Column:
    return F.when(value != "", F.replace(html, value, F.lit(""))).otherwise(html)


def apply_rules(html: Column, rules: Column) -> Column:
    """All rules in array order; rules with an empty value or an unknown type change nothing."""

    def one(h: Column, rule: Column) -> Column:
        kind, value = strip(rule["type"]), F.coalesce(rule["value"], F.lit(""))
        return F.coalesce(
            F.when(kind == "start", cut_start(h, value))
            .when(kind == "end", cut_end(h, value))
            .when(kind == "exact", delete_exact(h, value))
            .otherwise(h),
            h,
        )

    return F.aggregate(rules, html, one)


def exclude(html: Column, rules: Column) -> Column:
    """Rules, then removal of emptied elements; sources without rules are left alone."""
    some = F.coalesce(F.size(rules) > 0, F.lit(False))
    return F.when(some, let(apply_rules(html, rules), tree.drop_empty)).otherwise(html)


def rule_problem(rule: Column) -> Column:
    """Why a rule has no effect; null when it is fine."""
    kind = strip(F.coalesce(rule["type"], F.lit("")))
    return F.when(F.coalesce(rule["value"], F.lit("")) == "", "empty value").when(
        ~kind.isin("start", "end", "exact"), F.concat(F.lit("unknown type: "), kind)
    )
