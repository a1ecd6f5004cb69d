"""Text Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv

SPACE = f"[{fv.SPACE_CLASS}]"


def literal(text: str) -> Column:
    """A string literal that is safe for any content."""
    return F.lit(text)


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends; only the ends are looked at."""
    return F.btrim(col, F.lit(fv.SPACE_CHARS))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def replace_all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def decode_entities(col: Column) -> Column:
    return replace_all(col, fv.HTML_ENTITIES)


def escape(col: Column) -> Column:
    """Escape the five characters that are special in markup, ampersand first."""
    return replace_all(col, fv.HTML_ESCAPES)


def html_to_text(col: Column) -> Column:
    """Plain text of a markup string: script/style blocks and tags removed, entities decoded, white space collapsed."""
    body = F.regexp_replace(col, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    body = F.regexp_replace(body, r"<[^>]+>", "")
    body = F.regexp_replace(decode_entities(body), f"{SPACE}+", " ")
    return F.coalesce(F.trim(body), F.lit(""))


def truncate(col: Column, n: int = 200) -> Column:
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(n)), F.lit("..."))).otherwise(col)


def sanitize_filename(col: Column) -> Column:
    """Illegal characters and runs of white space as '_', trimmed and cut; one pattern pass over the text."""
    name = F.trim(F.regexp_replace(col, f"{SPACE}+", " "))
    illegal = fv.ILLEGAL_FILENAME_CLASS.replace("\\\\", "\\") + " "
    return F.left(F.translate(name, illegal, "_" * len(illegal)), F.lit(fv.MAX_FILENAME))


def strip_fences(col: Column) -> Column:
    """Remove code-fence markers with their language word, then trim."""
    return strip(F.regexp_replace(col, fv.CODE_FENCE, ""))


def render_title(col: Column, as_of: Column) -> Column:
    """Fill ``{prefix {time}}`` and bare ``{time}`` with the edition date."""
    day = F.date_format(as_of, "yyyy-MM-dd")
    nested = F.regexp_replace(col, rf"\{{{SPACE}*([^{{}}]*?){SPACE}*\{{time\}}\}}", "$1 {time}")
    # a template made of blanks only before {time} leaves the separating blank, as trimming an empty prefix does
    return F.replace(nested, F.lit("{time}"), day)


def render_plain_title(col: Column, as_of: Column) -> Column:
    return strip(F.regexp_replace(render_title(col, as_of), r"<[^>]+>", ""))


def paragraphs(col: Column) -> Column:
    """Wrap each block between blank lines in ``<p>``."""
    blocks = F.filter(F.transform(F.split(col, r"\n[ \t]*\n"), strip), lambda b: b != "")
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("<p>"), b, F.lit("</p>"))), "")
