"""Markup as an array of tokens: per-token predicates and rewrites, all as Column functions.

A token is a text run, a tag, a comment, or a whole script/style block.  Rules that look at one token use
``transform``/``filter`` on the array; rules that need the tree fold over it (see ``tree``).  Nothing here shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions.fold import let
from broadsheet.functions.textops import decode_entities, strip

# Same language as fv.TOKEN; possessive loops keep the matcher's stack flat on very long tags.
_TOKEN_JVM = fv.TOKEN.replace("""(?:[^'">]+|"[^"]*"|'[^']*')*""", """(?:[^'">]++|"[^"]*+"|'[^']*+')*+""")
# White space, name, optional value; one attribute inside a tag.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s\"'>]+"
_ATTR = rf"[^\s\"'<>/=]+(?:\s*=\s*(?:{_VALUE}))?"


def split_tokens(html: Column) -> Column:
    """Every character of the markup, in order, as an array of tokens."""
    return F.regexp_extract_all(html, F.lit(_TOKEN_JVM), F.lit(0))


def name_of(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][a-zA-Z0-9:_-]*)", 1))


def kind_of(raw: Column, name: Column) -> Column:
    return (
        F.when(~raw.startswith("<") | (raw == "<"), "text")
        .when(raw.startswith("<!") | raw.startswith("<?"), "comment")
        .when(raw.startswith("</"), "close")
        .when(name.isin("script", "style") & raw.rlike(r"(?i)</(script|style)\s*>\z"), "raw")
        .when(name.isin(fv.VOID_TAGS) | raw.endswith("/>"), "void")
        .otherwise("open")
    )


def parse(html: Column) -> Column:
    """Tokens as ``array<struct<raw, name, kind>>``."""

    def token(raw: Column, name: Column, kind: Column) -> Column:
        return F.struct(raw.alias("raw"), name.alias("name"), kind.alias("kind"))

    def one(r: Column) -> Column:
        is_text = ~r.startswith("<") | (r == "<")
        return F.when(is_text, token(r, F.lit(""), F.lit("text"))).otherwise(
            let(name_of(r), lambda n: token(r, n, kind_of(r, n)))
        )

    return F.transform(split_tokens(html), one)


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def map_tokens(html: Column, f: Callable[[Column], Column]) -> Column:
    """Rewrite every token; a null result drops it."""
    return join_tokens(F.transform(split_tokens(html), f))


# --- attributes -----------------------------------------------------------------------------------------------------
def _others(name: str) -> str:
    """The attributes before the first one of that name; possessive, so a tag of any length is read in a loop."""
    return rf"(?:[\s/]+(?!{name}[\s=/>]){_ATTR})*+"


def _attr_pattern(name: str, value: str) -> str:
    return rf"(?is)^<[a-z][^\s/>]*+{_others(name)}[\s/]+{name}{value}"


def attr(raw: Column, name: str) -> Column:
    """Attribute value as written in the tag, without its quotes; '' when absent."""
    quoted = F.regexp_extract(raw, _attr_pattern(name, rf"\s*=\s*({_VALUE})"), 1)
    return F.regexp_replace(quoted, r"^[\"']|[\"']\z", "")


def attr_text(raw: Column, name: str) -> Column:
    """Attribute value with entities decoded."""
    return decode_entities(attr(raw, name))


def has_attr(raw: Column, name: str) -> Column:
    return raw.rlike(_attr_pattern(name, r"(?:[\s=/>])"))


def drop_attr(raw: Column, name: str) -> Column:
    return F.regexp_replace(raw, rf"(?is)^(<[a-z][^\s/>]*+{_others(name)})[\s/]+{name}(?:\s*=\s*(?:{_VALUE})|(?=[\s/>]))", "$1")


def replace_attr(raw: Column, name: str, value: Column) -> Column:
    """New value for an attribute the tag has, in its place."""
    found = F.regexp_extract(raw, _attr_pattern(name, rf"\s*=\s*({_VALUE})"), 0)
    old = F.regexp_extract(found, rf"({_VALUE})\z", 1)

    def write(head: Column) -> Column:
        return F.concat(
            F.left(head, F.length(head) - F.length(old)),
            F.lit('"'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'),
            F.substring(raw, F.length(head) + 1, F.length(raw)),
        )

    return let(found, write)


def set_attr(raw: Column, name: str, value: Column) -> Column:
    """Replace the attribute's value in place, or append the attribute."""
    end = F.regexp_extract(raw, r"\s*/?>\z", 0)
    text = F.concat(F.lit(f' {name}="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    appended = F.concat(F.left(raw, F.length(raw) - F.length(end)), text, end)
    valued = raw.rlike(_attr_pattern(name, r"\s*="))
    return F.when(valued, replace_attr(raw, name, value)).when(has_attr(raw, name), raw).otherwise(appended)


def attr_list(raw: Column) -> Column:
    """All attributes of a tag as ``array<struct<name, text>>``; ``text`` is the attribute as written."""
    body = F.regexp_replace(raw, r"^<[a-zA-Z][^\s/>]*|\s*/?>\z", "")
    found = F.regexp_extract_all(body, F.lit(_ATTR), F.lit(0))
    return F.transform(
        found, lambda a: F.struct(F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"), a.alias("text"))
    )


def rebuild_tag(raw: Column, name: Column, attrs: Column) -> Column:
    """A tag from its name and attribute texts, keeping a self-closing end."""
    texts = F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a)), "")
    end = F.when(raw.endswith("/>"), "/>").otherwise(">")
    return F.concat(F.lit("<"), name, texts, end)


def is_tag(raw: Column) -> Column:
    return raw.rlike(r"^<[a-zA-Z]")


# --- rules on one token ---------------------------------------------------------------------------------------------
def filter_attrs(raw: Column, name: Column) -> Column:
    """Keep only allowed attributes; width and height only on images."""
    def keep(a: Column) -> Column:
        sized = a["name"].isin("width", "height")
        return a["name"].isin(fv.ALLOWED_ATTRS) & (~sized | (name == "img"))

    kept = F.transform(F.filter(attr_list(raw), keep), lambda a: a["text"])
    return F.when(raw.contains("="), rebuild_tag(raw, name, kept)).when(
        raw.rlike(r"\s"), rebuild_tag(raw, name, kept)
    ).otherwise(raw)


def sanitize_attr_names(raw: Column) -> Column:
    """Drop attributes whose name is not a legal XML name; lower-case the others."""
    kept = F.filter(attr_list(raw), lambda a: a["name"].rlike(fv.XML_ATTR_NAME))
    texts = F.transform(
        kept, lambda a: F.concat(a["name"], F.substring(a["text"], F.length(a["name"]) + 1, F.length(a["text"])))
    )
    return F.when(is_tag(raw) & raw.rlike(r"\s"), rebuild_tag(raw, name_of(raw), texts)).otherwise(raw)


def _style_value(style: Column, is_img: Column) -> Column:
    plain = F.regexp_replace(style, fv.COLOR_STYLE, "")

    def prop(p: Column) -> Column:
        return F.lower(strip(F.regexp_extract(p, r"(?s)^([^:]*):", 1)))

    def kept(p: Column) -> Column:
        return p.contains(":") & ~prop(p).isin(fv.LAYOUT_PROPERTIES) & ~prop(p).contains("background")

    parts = F.filter(F.transform(F.split(plain, ";"), strip), kept)
    other = F.array_join(
        F.transform(parts, lambda p: F.concat(prop(p), F.lit(":"), strip(F.regexp_extract(p, r"(?s)^[^:]*:(.*)", 1)))), ";"
    )
    return F.regexp_replace(strip(F.when(is_img, plain).otherwise(other)), r"^;+|;+\z", "")


def filter_style(raw: Column, name: Column) -> Column:
    """Remove colours everywhere and layout properties outside images; an emptied style attribute goes."""
    def apply(value: Column) -> Column:
        return F.when(value == "", drop_attr(raw, "style")).otherwise(replace_attr(raw, "style", value))

    styled = raw.rlike(r"(?is)^<[a-z].*\sstyle\s*=")
    return F.when(styled, let(_style_value(attr(raw, "style"), name == "img"), apply)).otherwise(raw)


def int_dimensions(raw: Column, name: Column) -> Column:
    """Whole-number width and height on images; unreadable or blank values lose the attribute."""
    def fix(tag: Column, which: str) -> Column:
        number = strip(attr(tag, which)).try_cast("double")
        small = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("string")
        readable = ~F.isnan(number) & (F.abs(number) < float("inf"))
        # beyond whole doubles every value is whole already
        whole = F.when(F.abs(number) < 1e15, small).when(readable, F.format_string("%.0f", number))
        changed = F.when(whole.isNull(), drop_attr(tag, which)).otherwise(replace_attr(tag, which, whole))
        return F.when(has_attr(tag, which), changed).otherwise(tag)

    sized = (name == "img") & raw.rlike(r"(?is)\s(width|height)")
    return F.when(sized, let(fix(raw, "width"), lambda t: fix(t, "height"))).otherwise(raw)


def font_style(raw: Column) -> Column:
    """Style text of a font tag: family from face, pixels from size."""
    face, size = attr(raw, "face"), attr(raw, "size")
    pixels = F.coalesce(
        F.create_map(*[F.lit(x) for kv in fv.FONT_SIZE_PX.items() for x in kv])[size], F.lit(fv.FONT_SIZE_DEFAULT_PX)
    )
    return F.array_join(
        F.array(
            F.when(face != "", F.concat(F.lit("font-family:"), face)),
            F.when(size != "", F.concat(F.lit("font-size:"), pixels, F.lit("px"))),
        ),
        ";",
    )


def rename_tag(raw: Column, name: Column) -> Column:
    """row, cell and font tags under their standard names; font attributes become a style."""
    def as_span(style: Column) -> Column:
        bare = drop_attr(drop_attr(drop_attr(raw, "color"), "face"), "size")
        spanned = F.regexp_replace(bare, r"(?i)^<font", "<span")
        return F.when(style == "", spanned).otherwise(set_attr(spanned, "style", style))

    return (
        F.when(name == "font", F.when(raw.startswith("</"), F.lit("</span>")).otherwise(let(font_style(raw), as_span)))
        .when(name == "row", F.regexp_replace(raw, r"(?i)^(</?)row", "$1tr"))
        .when(name == "cell", F.regexp_replace(raw, r"(?i)^(</?)cell", "$1td"))
        .otherwise(raw)
    )


def new_name(name: Column) -> Column:
    return F.when(name == "row", "tr").when(name == "cell", "td").when(name == "font", "span").otherwise(name)


def restore_images(html: Column) -> Column:
    """graphic tags back to img tags."""
    swapped = map_tokens(
        html,
        lambda t: F.when(name_of(t) == "graphic", F.regexp_replace(t, r"(?i)^(</?)graphic", "$1img")).otherwise(t),
    )
    return F.when(html.rlike(r"(?i)<graphic"), swapped).otherwise(html)


def unwrap_links(html: Column) -> Column:
    """Drop link tags, keep what they hold."""
    return join_tokens(F.filter(split_tokens(html), lambda t: name_of(t) != "a"))


def has_emoji(text: Column) -> Column:
    """Whether any emoji occurs; one character class, for skipping the rule cheaply."""
    return text.rlike("[" + "".join(re.findall(r"\[(.*?)\]", fv.EMOJI)) + "]")


def wrap_emoji(text: Column) -> Column:
    """Each emoji inside a marked span; texts without one are passed over by a single character class."""
    return F.when(has_emoji(text), F.regexp_replace(text, f"({fv.EMOJI})", '<span class="emoji">$1</span>')).otherwise(text)


def find_emoji(html: Column) -> Column:
    """Emoji marked in the markup, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<span class="emoji">([^<]*)</span>'), F.lit(1))


def emoji_codepoint(emoji: Column) -> Column:
    """Lower-case hex code points joined by '-'."""
    chars = F.filter(F.split(emoji, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.lower(F.hex(F.ascii(c)))), "-")


def emoji_to_images(html: Column) -> Column:
    """Marked emoji to image references named after their code points."""
    mark, end = '<span class="emoji">', "</span>"

    def image(piece: Column, i: Column) -> Column:
        emoji = F.regexp_extract(piece, r"^([^<]*)</span>", 1)
        tag = F.concat(
            F.lit('<img src="images/emoji_'), emoji_codepoint(emoji), F.lit('.png" alt="'), emoji,
            F.lit(f'" class="emoji" style="{fv.EMOJI_IMAGE_STYLE}">'),
            F.substring(piece, F.length(emoji) + len(end) + 1, F.length(piece)),
        )
        marked = piece.rlike(r"^[^<]*</span>")
        return F.when(i == 0, piece).when(marked, tag).otherwise(F.concat(F.lit(mark), piece))

    pieces = F.split(html, mark, -1)
    return F.when(html.contains(mark), F.array_join(F.transform(pieces, image), "")).otherwise(html)
