"""Adapters by source type.  An adapter turns landed payloads into ``(articles, runs)`` DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTICLES = (
    "source_pos int, item_pos int, title string, content string, url string, author string, published_date string, "
    "images array<string>, metadata map<string,string>"
)
RUNS = "source_pos int, success boolean, error string, source_title string"
ARTICLE_COLUMNS = [c.strip().split(" ")[0] for c in ARTICLES.split(", ")]
RUN_COLUMNS = [c.strip().split(" ")[0] for c in RUNS.split(", ")]


@dataclass(frozen=True)
class Context:
    """What an adapter may need besides its payloads."""

    sources: DataFrame
    landing: Callable[[str], DataFrame | None]
    global_limit: int
    as_of: object


Adapter = Callable[[Context], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Entry:
    adapter: Adapter
    options: dict[str, str] = field(default_factory=dict)


_entries: dict[str, Entry] = {}


def source(type_name: str, options: dict[str, str] | None = None) -> Callable[[Adapter], Adapter]:
    """Register an adapter under a source type; ``options`` maps option keys to their type."""

    def add(adapter: Adapter) -> Adapter:
        _entries[type_name] = Entry(adapter, dict(options or {}))
        return adapter

    return add


def get(type_name: str) -> Adapter:
    if type_name not in _entries:
        raise ValueError(f"Unknown source type: {type_name}")
    return _entries[type_name].adapter


def options(type_name: str) -> dict[str, str]:
    get(type_name)
    return dict(_entries[type_name].options)


def types() -> list[str]:
    return sorted(_entries)


def unreadable_options(sources: DataFrame) -> DataFrame:
    """Metadata options that are not declared for their type or cannot be read as declared."""
    rows = sources.select("source_pos", "type", F.explode("metadata").alias("key", "value"))
    known = F.lit(False)
    readable = F.lit(False)
    for type_name, entry in _entries.items():
        for key, kind in entry.options.items():
            if key.startswith("metadata."):
                here = (F.col("type") == type_name) & (F.col("key") == key.removeprefix("metadata."))
                known = known | here
                readable = readable | (here & F.col("value").try_cast(kind).isNotNull())
    problem = F.when(~known, "unknown option").when(~readable, "unreadable value")
    return rows.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def as_articles(df: DataFrame) -> DataFrame:
    """The article columns in order; absent ones are null or empty."""
    defaults = {
        "author": F.lit(None).cast("string"),
        "published_date": F.lit(None).cast("string"),
        "images": F.array().cast("array<string>"),
        "metadata": F.lit(None).cast("map<string,string>"),
    }
    kinds = dict(c.strip().split(" ", 1) for c in ARTICLES.split(", "))
    return df.select(
        *[(F.col(c) if c in df.columns else defaults[c]).cast(kinds[c]).alias(c) for c in ARTICLE_COLUMNS]
    )


def as_runs(df: DataFrame) -> DataFrame:
    kinds = dict(c.strip().split(" ", 1) for c in RUNS.split(", "))
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in RUN_COLUMNS]
    )
