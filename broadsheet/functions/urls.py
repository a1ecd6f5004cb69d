"""URL Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions.fold import let


def _clean(url: Column) -> Column:
    """What every URL reader drops first: leading control characters and blanks, and tabs or line breaks anywhere."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), fv.URL_PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(_clean(url), fv.URL_PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(_clean(url), fv.URL_PARTS, 3)


def normalize(url: Column) -> Column:
    """``scheme://netloc/path`` without query, fragment, path parameters of the last segment, and trailing slashes."""
    plain = F.when(scheme(url).isin(fv.PARAM_SCHEMES), F.regexp_replace(path(url), r";[^/]*\z", "")).otherwise(path(url))
    full = F.concat(scheme(url), F.lit("://"), netloc(url), plain)
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(F.regexp_replace(full, r"/+\z", ""))


def is_valid(url: Column) -> Column:
    return F.coalesce((scheme(url) != "") & (netloc(url) != ""), F.lit(False))


def is_web(url: Column) -> Column:
    """Absolute http(s) address, compared as written."""
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def _join_path(base_path: Column, rel_path: Column) -> Column:
    """Relative path against the directory of the base path, dot segments resolved."""
    directory = F.regexp_replace(base_path, r"[^/]*\z", "")
    rooted = F.when(rel_path.startswith("/"), rel_path).otherwise(F.concat(directory, rel_path))

    def resolve(parts: Column) -> Column:
        last = F.size(parts)
        kept = F.when(rel_path.startswith("/"), parts).otherwise(
            F.filter(parts, lambda s, i: (i == 0) | (i == last - 1) | (s != ""))
        )
        folded = F.aggregate(
            kept,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        ends_in_dots = F.element_at(parts, -1).isin(".", "..")
        done = F.array_join(F.when(ends_in_dots, F.array_append(folded, F.lit(""))).otherwise(folded), "/")
        return F.when(done == "", F.lit("/")).otherwise(done)

    return let(F.split(rooted, "/", -1), resolve)


def base_parts(base: Column) -> Column:
    """What joining needs of a base address, computed once per row."""
    b_scheme, b_netloc = scheme(base), netloc(base)
    root = F.when(b_scheme != "", F.concat(b_scheme, F.lit(":"))).otherwise(F.lit(""))
    return F.struct(
        base.alias("base"),
        b_scheme.alias("scheme"),
        b_netloc.alias("netloc"),
        root.alias("root"),
        F.concat(root, F.when(b_netloc != "", F.concat(F.lit("//"), b_netloc)).otherwise(F.lit(""))).alias("host"),
        path(base).alias("path"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
    )


def resolve_in(url: Column, b: Column) -> Column:
    """Join a reference with the parts of a base address.  Without a base only ``//host`` gets a scheme."""
    tail = F.regexp_extract(url, r"^[^?#]*((?s:.*))", 1)
    rel_path = path(url)
    slash = lambda joined: F.when((b["netloc"] != "") & ~joined.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    no_base = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    rooted = url.startswith("/") & ~url.startswith("//") & ~url.contains("/.")
    # a scheme that differs from the base's, or an authority, makes the reference absolute
    absolute = (scheme(url) != "") & ((scheme(url) != b["scheme"]) | (netloc(url) != ""))
    return (
        F.when(F.coalesce(b["base"], F.lit("")) == "", no_base)
        .when(url == "", b["base"])
        .when(rooted, F.concat(b["host"], url))
        .when(url.startswith("//"), F.concat(b["root"], url))
        .when(url.startswith("?"), F.concat(b["host"], b["path"], tail))
        .when(url.startswith("#"), F.concat(b["host"], b["path"], b["query"], tail))
        .when(absolute, url)
        .otherwise(let(_join_path(b["path"], rel_path), lambda j: F.concat(b["host"], slash(j), j, tail)))
    )


def resolve(url: Column, base: Column) -> Column:
    """Join a reference with a base address."""
    return let(base_parts(base), lambda b: resolve_in(url, b))
