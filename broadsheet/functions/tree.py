"""Rules that need the element tree, as folds over the token array of one row.

The stack of open elements is the fold state.  A closing tag closes everything opened inside its element; a closing tag
without an open element is dropped; elements still open at the end are closed in reverse order.  The result is always
well nested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import markup as m
from broadsheet.functions import urls
from broadsheet.functions.fold import fold_emit, let
from broadsheet.functions.textops import SPACE, strip

KEEP, UNWRAP, CUT = "keep", "unwrap", "cut"
_EMOJI_OPEN = '<span class="emoji">'


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _no_ints() -> Column:
    return F.array().cast("array<int>")


def last_index(names: Column, name: Column) -> Column:
    """1-based index of the innermost open element of that name, 0 when there is none."""
    back = F.array_position(F.reverse(names), name).cast("int")
    return F.when(back > 0, F.size(names) - back + 1).otherwise(0)


def token(t: Column, act: Column, out: Column) -> Column:
    """An annotated token: what to do with its element, its text on output, and whether it starts a block."""
    return F.struct(
        t["raw"].alias("raw"),
        t["name"].alias("name"),
        t["kind"].alias("kind"),
        act.alias("act"),
        out.alias("out"),
        (t["kind"].isin("open", "void") & t["name"].isin(fv.BLOCK_TAGS)).alias("block"),
    )


def annotate(tokens: Column, act: Callable[[Column, Column], Column], out: Callable[[Column], Column] | None = None) -> Column:
    """Attach to each token what to do with its element (``act(token, position)``) and its text on output."""
    return F.transform(tokens, lambda t, i: token(t, act(t, i), out(t) if out else t["raw"]))


def rebuild(tokens: Column, close_paragraphs: bool = False, mark_emoji: Column | None = None) -> Column:
    """Write annotated tokens back as a well-nested fragment.

    ``unwrap`` drops the tags of an element and keeps its content, ``cut`` drops the element with its content.  With
    ``close_paragraphs`` a block element ends an open paragraph first.  A link inside a link ends the outer one.
    ``mark_emoji`` says whether the row has emoji to wrap.
    """
    # names: open elements; ends: what closes each of them ('' when its tags are not written);
    # cut: stack size at which the content being cut began, 0 outside; marked: directly inside a marked emoji
    init = {"names": _no_strings(), "ends": _no_strings(), "cut": F.lit(0)}
    if mark_emoji is not None:
        init["marked"] = F.lit(False)

    def step(get, then, t):
        names, ends, cut = get("names"), get("ends"), get("cut")
        kind, name, act = t["kind"], t["name"], t["act"]
        unmarked = {"marked": F.lit(False)} if mark_emoji is not None else {}

        def text() -> Column:
            if mark_emoji is None:
                return t["out"]
            return F.when(mark_emoji & (kind == "text") & ~get("marked"), m.wrap_emoji(t["out"])).otherwise(t["out"])

        def push(base_names: Column, base_ends: Column, cut_now: Column, closing: Column) -> Column:
            shown = (cut_now == 0) & (act == KEEP)
            end = F.when(shown, F.concat(F.lit("</"), m.new_name(name), F.lit(">"))).otherwise("")
            marked = {"marked": t["raw"] == _EMOJI_OPEN} if mark_emoji is not None else {}
            return then(
                F.concat(closing, F.when(shown, t["out"]).otherwise("")),
                names=F.array_append(base_names, name),
                ends=F.array_append(base_ends, end),
                cut=F.when((cut_now == 0) & (act == CUT), F.size(base_names) + 1).otherwise(cut_now),
                **marked,
            )

        def pop(k: Column) -> Column:
            """End the elements from the k-th on, then do what the token asks for."""
            kept_names, kept_ends = F.slice(names, 1, k - 1), F.slice(ends, 1, k - 1)
            closing = F.array_join(F.reverse(F.slice(ends, k, F.size(names))), "")
            cut_left = F.when(cut >= k, 0).otherwise(cut)
            return (
                F.when(kind == "open", push(kept_names, kept_ends, cut_left, closing))
                .when(kind == "close", then(closing, names=kept_names, ends=kept_ends, cut=cut_left, **unmarked))
                .otherwise(then(F.concat(closing, t["out"]), names=kept_names, ends=kept_ends, cut=cut_left, **unmarked))
            )

        flowing = F.when((cut > 0) | (act != KEEP), "").otherwise(text())
        in_paragraph = F.lit(False)
        if close_paragraphs:
            in_paragraph = t["block"] & (cut == 0) & (act == KEEP) & F.array_contains(names, "p")
        in_link = (name == "a") & (kind == "open") & F.array_contains(names, "a")
        return (
            F.when((kind == "text") | ((kind != "open") & (kind != "close") & ~in_paragraph), then(flowing))
            .when(in_paragraph, let(F.array_position(names, "p").cast("int"), pop))
            .when((kind == "open") & ~in_link, push(names, ends, cut, F.lit("")))
            .otherwise(
                let(last_index(names, name), lambda k: F.when(k > 0, pop(k)).otherwise(then(F.lit(""), **unmarked)))
            )
        )

    return fold_emit(tokens, init, step, lambda get: F.array_join(F.reverse(get("ends")), ""))


# --- structure only -------------------------------------------------------------------------------------------------
_SHELL_TAGS = ["html", "body"]


def _shell(t: Column) -> Column:
    """Document shell: only what is inside the body is content."""
    return (
        F.when(t["name"].isin(_SHELL_TAGS), UNWRAP)
        .when(t["name"] == "head", CUT)
        .when((t["kind"] == "comment") & t["raw"].rlike(r"(?i)^<(!doctype|\?)"), CUT)
        .otherwise(KEEP)
    )


def balance(html: Column) -> Column:
    """Body content with every element closed and stray closing tags gone."""
    return let(m.parse(html), lambda ts: rebuild(annotate(ts, lambda t, i: _shell(t))))


def drop_elements(html: Column, names: list[str]) -> Column:
    """Remove the named elements with their content."""
    return let(
        m.parse(html),
        lambda ts: rebuild(annotate(ts, lambda t, i: F.when(t["name"].isin(names), CUT).otherwise(KEEP))),
    )


def fix_nested_blocks(html: Column) -> Column:
    """End an open paragraph before a block element."""
    return let(m.parse(html), lambda ts: rebuild(annotate(ts, lambda t, i: F.lit(KEEP)), close_paragraphs=True))


def mark_emoji(html: Column) -> Column:
    """Wrap emoji of text tokens, those already marked excepted."""
    wrapped = let(
        m.parse(html), lambda ts: rebuild(annotate(ts, lambda t, i: F.lit(KEEP)), mark_emoji=F.lit(True))
    )
    return F.when(m.has_emoji(html), wrapped).otherwise(html)


# --- links ----------------------------------------------------------------------------------------------------------
def _link_target(href: Column, base: Column) -> Column:
    """Address a link ends up with (``base`` holds the parts of the article's address); null: unwrap the link."""

    def absolute() -> Column:
        known = urls.scheme(href).isin(fv.LINK_SCHEMES)
        has_base = F.coalesce(base["base"], F.lit("")) != ""
        resolved = let(urls.resolve_in(href, base), lambda r: F.when(urls.scheme(r).isin("http", "https"), r))
        return F.replace(F.when(known, href).when(has_base, resolved), F.lit(" "), F.lit("%20"))

    ready = href.startswith("#") | href.rlike(r"^https?:[^ ]*\z")
    return F.when(ready, href).when(href != "", absolute())


def _link_fields(t: Column, base: Column) -> Column:
    """act and out of a link token."""
    raw = t["raw"]

    def fields(act: str, out: Column) -> Column:
        return F.struct(F.lit(act).alias("act"), out.alias("out"))

    def choose(href: Column, target: Column) -> Column:
        written = F.replace(target, F.lit("&"), F.lit("&amp;"))
        return (
            F.when(target.isNull(), fields(UNWRAP, raw))
            .when(target == href, fields(KEEP, raw))
            .otherwise(fields(KEEP, m.replace_attr(raw, "href", written)))
        )

    def decide(href: Column) -> Column:
        return let(_link_target(href, base), lambda target: choose(href, target))

    targeted = (t["kind"] == "open") & raw.rlike(r"(?i)[\s/]href[\s=>]")
    valued = let(strip(m.attr_text(raw, "href")), lambda h: F.when((h == "") & ~m.has_attr(raw, "href"), fields(KEEP, raw)).otherwise(decide(h)))
    return F.when(targeted, valued).otherwise(fields(KEEP, raw))


def link_tokens_in(tokens: Column, parts: Column, keep_link: Column | None = None) -> Column:
    """Tokens with the link rules applied: every link unwrapped, or addresses made absolute and bad ones unwrapped.

    ``parts`` are the parts of the article's address.
    """

    def one(t: Column) -> Column:
        fields = _link_fields(t, parts)
        if keep_link is not None:
            fields = F.when(
                (keep_link == "N") & (t["name"] == "a"), F.struct(F.lit(UNWRAP).alias("act"), t["raw"].alias("out"))
            ).otherwise(fields)
        return let(fields, lambda f: token(t, f["act"], f["out"]))

    return F.transform(
        tokens, lambda t: F.when(t["name"] == "a", one(t)).otherwise(token(t, F.lit(KEEP), t["raw"]))
    )


def link_tokens(tokens: Column, base: Column, keep_link: Column | None = None) -> Column:
    """The same from the article's address; everything a token needs of its row is computed once."""
    keep = F.coalesce(keep_link, F.lit("Y")) if keep_link is not None else F.lit("Y")
    row = F.struct(urls.base_parts(base).alias("parts"), keep.alias("keep"))
    return let(row, lambda r: link_tokens_in(tokens, r["parts"], r["keep"] if keep_link is not None else None))


def normalize_links(html: Column, base: Column) -> Column:
    """Absolute, space-free link addresses; links without a usable address are unwrapped."""
    return let(m.parse(html), lambda ts: rebuild(link_tokens(ts, base)))


# --- small icons in links -------------------------------------------------------------------------------------------
def _small_image(raw: Column) -> Column:
    def small(digits: Column) -> Column:
        plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
        return (F.length(plain) < 10) & (plain.try_cast("int") <= fv.SMALL_ICON_PX)

    def tiny(which: str) -> Column:
        value = m.attr(raw, which)
        return value.rlike(r"^[0-9]+\z") & small(value)

    style = F.lower(m.attr(raw, "style"))
    pixels = F.regexp_extract_all(style, F.lit(r"([0-9]+)px"), F.lit(1))
    in_style = style.contains("width") & F.exists(pixels, small)
    return F.coalesce(tiny("width") | tiny("height") | in_style, F.lit(False))


def small_icon_links(tokens: Column) -> Column:
    """Positions of the links (not unwrapped ones) that hold a small image."""
    indexed = F.transform(
        tokens, lambda t, i: F.struct(i.alias("i"), t["raw"].alias("raw"), t["name"].alias("name"), t["kind"].alias("kind"),
                                      t["act"].alias("act"))
    )
    relevant = F.filter(indexed, lambda t: t["name"].isin("a", "img") & (t["act"] == KEEP))
    start = F.struct(F.lit(-1).alias("link"), _no_ints().alias("hits"))

    def walk(acc: Column, t: Column) -> Column:
        hit = (t["name"] == "img") & (acc["link"] >= 0) & _small_image(t["raw"])
        return F.struct(
            F.when((t["name"] == "a") & (t["kind"] == "open"), t["i"])
            .when((t["name"] == "a") & (t["kind"] == "close"), -1)
            .otherwise(acc["link"])
            .alias("link"),
            F.when(hit, F.array_append(acc["hits"], acc["link"])).otherwise(acc["hits"]).alias("hits"),
        )

    return F.aggregate(relevant, start, walk, lambda acc: acc["hits"])


def _cut_at(tokens: Column, hits: Column) -> Column:
    def one(t: Column, i: Column) -> Column:
        return F.when(F.array_contains(hits, i), token(t, F.lit(CUT), t["out"])).otherwise(t)

    return F.transform(tokens, lambda t, i: F.when((t["name"] == "a") & (t["kind"] == "open"), one(t, i)).otherwise(t))


def cut_small_icons(tokens: Column) -> Column:
    """Annotated tokens with icon links set to be cut."""
    has_images = F.exists(tokens, lambda t: t["name"] == "img")
    hits = F.when(has_images, small_icon_links(tokens)).otherwise(_no_ints())
    return let(hits, lambda h: F.when(F.size(h) > 0, _cut_at(tokens, h)).otherwise(tokens))


def drop_small_icons(html: Column) -> Column:
    """Remove links that hold a small image."""
    return let(
        m.parse(html),
        lambda ts: let(annotate(ts, lambda t, i: F.lit(KEEP)), lambda a: rebuild(cut_small_icons(a))),
    )


# --- layout tables --------------------------------------------------------------------------------------------------
def layout_tables(tokens: Column) -> Column:
    """Token intervals ``array<struct<first, last>>`` of the tables that only serve layout.

    Decided from the innermost table outwards: a layout role, at most one cell in every row that is a direct child of
    the table, or a data table inside.
    """
    entry = "array<struct<name:string,first:int,n:int,role:boolean,data:boolean>>"
    spans = "array<struct<first:int,last:int>>"
    indexed = F.transform(
        tokens, lambda t, i: F.struct(i.alias("i"), t["raw"].alias("raw"), t["name"].alias("name"), t["kind"].alias("kind"))
    )
    parts = F.filter(
        indexed, lambda t: t["name"].isin("table", *fv.TABLE_PART_TAGS) & t["kind"].isin("open", "close")
    )
    # tables never closed end with the document
    end = F.struct(
        F.size(tokens).alias("i"), F.lit("").alias("raw"), F.lit("table").alias("name"), F.lit("close").alias("kind")
    )
    opened = F.size(F.filter(parts, lambda t: (t["name"] == "table") & (t["kind"] == "open")))
    events = F.concat(parts, F.array_repeat(end, opened))
    start = F.struct(F.array().cast(entry).alias("stack"), F.array().cast(spans).alias("found"))

    def node(name, first, n, role, data) -> Column:
        return F.struct(
            name.alias("name"), first.alias("first"), n.alias("n"), role.alias("role"), data.alias("data")
        )

    def walk(acc: Column, t: Column) -> Column:
        stack, found = acc["stack"], acc["found"]
        name, kind = t["name"], t["kind"]

        def opened_in(s: Column) -> Column:
            """Stack once the new element is on it; a cell counts for its row, and the row for its table."""
            size = F.size(s)
            top, below = F.try_element_at(s, F.lit(-1)), F.try_element_at(s, F.lit(-2))
            cell = name.isin("td", "th") & (top["name"] == "tr")
            row = node(top["name"], top["first"], top["n"] + 1, top["role"], top["data"])
            table = node(
                below["name"], below["first"], F.greatest(below["n"], top["n"] + 1), below["role"], below["data"]
            )
            counted = (
                F.when(cell & (below["name"] == "table"), F.concat(F.slice(s, 1, F.greatest(size - 2, F.lit(0))), F.array(table, row)))
                .when(cell, F.concat(F.slice(s, 1, F.greatest(size - 1, F.lit(0))), F.array(row)))
                .otherwise(s)
            )
            role = (name == "table") & m.attr(t["raw"], "role").isin("presentation", "none")
            return F.array_append(counted, node(name, t["i"], F.lit(0), role, F.lit(False)))

        # a new row ends an open cell and row, a new cell ends an open cell
        def trimmed(s: Column) -> Column:
            drop_cell = name.isin("td", "th", "tr") & F.try_element_at(s, F.lit(-1))["name"].isin("td", "th")
            once = F.when(F.coalesce(drop_cell, F.lit(False)), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)

            def row_end(o: Column) -> Column:
                drop_row = (name == "tr") & (F.try_element_at(o, F.lit(-1))["name"] == "tr")
                return F.when(F.coalesce(drop_row, F.lit(False)), F.slice(o, 1, F.greatest(F.size(o) - 1, F.lit(0)))).otherwise(o)

            return let(once, row_end)

        def closed_at(k: Column) -> Column:
            rest = F.slice(stack, 1, F.greatest(k - 1, F.lit(0)))
            e = F.try_element_at(stack, F.greatest(k, F.lit(1)))
            layout = e["role"] | (e["n"] <= 1) | e["data"]
            is_table = name == "table"
            marked = F.transform(rest, lambda r: node(r["name"], r["first"], r["n"], r["role"], F.lit(True)))
            span = F.struct(e["first"].alias("first"), t["i"].alias("last"))
            return F.when(
                k > 0,
                F.struct(
                    F.when(is_table & ~layout, marked).otherwise(rest).alias("stack"),
                    F.when(is_table & layout, F.array_append(found, span)).otherwise(found).alias("found"),
                ),
            ).otherwise(acc)

        open_state = F.struct(let(trimmed(stack), opened_in).alias("stack"), found.alias("found"))
        names = F.transform(stack, lambda e: e["name"])
        return F.when(kind == "open", open_state).otherwise(let(last_index(names, name), closed_at))

    return F.aggregate(events, start, walk, lambda acc: acc["found"])


def _inside_spans(tokens: Column, spans: Column) -> Column:
    """Per token '1' for the tables that are spans and the table parts inside one; one pass, for pages of very many tables."""
    ordered = F.array_sort(spans)
    indexed = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t["name"].alias("name"), t["kind"].alias("kind")))

    def walk(sorted_spans: Column) -> Column:
        def step(get, then, t):
            span = F.get(sorted_spans, get("next"))
            opened = (t["name"] == "table") & (t["kind"] == "open") & F.coalesce(span["first"] == t["i"], F.lit(False))
            inside = t["name"].isin(fv.TABLE_PART_TAGS) & (t["i"] < get("until"))
            return F.when(opened, then(F.lit("1"), next=get("next") + 1, until=F.greatest(get("until"), span["last"]))).otherwise(
                then(F.when(inside, "1").otherwise("0"))
            )

        return fold_emit(indexed, {"next": F.lit(0), "until": F.lit(-1)}, step, lambda get: F.lit(""))

    return F.split(let(ordered, walk), "")


def unwrap_tables(tokens: Column) -> Column:
    """Annotated tokens with layout tables (and every table part inside one) set to be unwrapped."""
    has_tables = F.exists(tokens, lambda t: t["name"] == "table")
    none = F.array().cast("array<struct<first:int,last:int>>")

    def tabular(t: Column) -> Column:
        return t["name"].isin("table", *fv.TABLE_PART_TAGS)

    def mark(spans: Column) -> Column:
        def act(t: Column, i: Column) -> Column:
            table = (t["name"] == "table") & F.exists(spans, lambda s: s["first"] == i)
            part = t["name"].isin(fv.TABLE_PART_TAGS) & F.exists(spans, lambda s: (s["first"] < i) & (i < s["last"]))
            return F.when(table | part, UNWRAP).otherwise(t["act"])

        few = F.transform(tokens, lambda t, i: F.when(tabular(t), token(t, act(t, i), t["out"])).otherwise(t))
        many = let(
            _inside_spans(tokens, spans),
            lambda hit: F.transform(tokens, lambda t, i: F.when(F.get(hit, i) == "1", token(t, F.lit(UNWRAP), t["out"])).otherwise(t)),
        )
        return F.when(F.size(spans) > 32, many).when(F.size(spans) > 0, few).otherwise(tokens)

    return let(F.when(has_tables, layout_tables(tokens)).otherwise(none), mark)


def unwrap_layout_tables(html: Column) -> Column:
    """Turn layout tables into plain flow, keep data tables."""
    return let(
        m.parse(html),
        lambda ts: let(annotate(ts, lambda t, i: F.lit(KEEP)), lambda a: rebuild(unwrap_tables(a))),
    )


# --- empty elements -------------------------------------------------------------------------------------------------
def is_blank_text(raw: Column) -> Column:
    return raw.rlike(rf"^(?:{SPACE}|&nbsp;|&#160;)*+\z")


def drop_empty(html: Column) -> Column:
    """Remove elements that hold neither text nor a kept tag; parents emptied by that go too.

    An opening tag is held back until something inside it must be written, and is forgotten when its end comes first.
    """

    def step(get, then, t):
        names, held = get("names"), get("held")
        kind, name, raw = t["kind"], t["name"], t["raw"]
        fixed_tag = name.isin(*fv.KEPT_WHEN_EMPTY, "html", "body", "head")
        waiting = F.size(held) > 0
        last = F.element_at(held, -1)
        longer = F.array_append(F.slice(held, 1, F.size(held) - 1), F.concat(last, raw))
        wait = F.when(waiting, then(F.lit(""), held=longer)).otherwise(then(raw))
        write = F.when(waiting, then(F.concat(F.array_join(held, ""), raw), held=_no_strings())).otherwise(then(raw))
        forget = then(F.lit(""))

        def closed(k: Column) -> Column:
            live = F.size(names) - F.size(held)
            ended = F.transform(
                F.reverse(F.slice(names, k, F.greatest(live - k + 1, F.lit(0)))),
                lambda n: F.concat(F.lit("</"), n, F.lit(">")),
            )
            gone = then(
                F.array_join(ended, ""),
                names=F.slice(names, 1, k - 1),
                held=F.slice(held, 1, F.greatest(k - 1 - live, F.lit(0))),
            )
            return F.when(k > 0, gone).otherwise(forget)

        held_open = then(F.lit(""), names=F.array_append(names, name), held=F.array_append(held, raw))
        fixed_open = then(
            F.concat(F.array_join(held, ""), raw), names=F.array_append(names, name), held=_no_strings()
        )
        return (
            F.when(kind == "text", F.when(is_blank_text(raw), wait).otherwise(write))
            .when(kind == "close", let(last_index(names, name), closed))
            .when(kind == "open", F.when(fixed_tag, fixed_open).otherwise(held_open))
            .when(kind == "comment", wait)
            .when(kind == "raw", F.when(raw.rlike(rf"(?is)^<[^>]*>{SPACE}*</"), forget).otherwise(write))
            .when(fixed_tag, write)
            .otherwise(forget)
        )

    def finish(get) -> Column:
        live = F.slice(get("names"), 1, F.size(get("names")) - F.size(get("held")))
        return F.array_join(F.transform(F.reverse(live), lambda n: F.concat(F.lit("</"), n, F.lit(">"))), "")

    return let(m.parse(html), lambda ts: fold_emit(ts, {"names": _no_strings(), "held": _no_strings()}, step, finish))
