"""The daily edition as one plan.

sources -> articles and runs -> first occurrences not in the ledger -> cleaned -> sections, chapters, contents, pages.
Bodies are cleaned only for new articles.  The articles found, with their ids, and then the new ones are staged once as tables in
the run's work folder: the first occurrences and the bodies both read the former, every edition table and the ledger the latter;
a lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import dates
from broadsheet.operators import articles as art
from broadsheet.operators import assets, edition, ledger, stats
from broadsheet.sources import bookmarks, config, feeds, forecast, mail, registry, sinks, trending, web  # noqa: F401

Landing = Callable[[str], DataFrame | None]


def collect_sources(
    spark: SparkSession, sources: DataFrame, landing: Landing, global_limit: int, as_of: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """Articles and runs of every configured type.  A source without a landed payload is a failed run."""
    ctx = registry.Context(sources, landing, global_limit, as_of)
    kinds = [r["type"] for r in sources.select("type").distinct().collect()]
    article_parts = [spark.createDataFrame([], registry.ARTICLES)]
    run_parts = [spark.createDataFrame([], registry.RUNS)]
    for kind in sorted(kinds):
        if landing(kind) is None:
            continue
        rows, runs = registry.get(kind)(ctx)
        article_parts.append(registry.as_articles(rows))
        run_parts.append(registry.as_runs(runs))
    runs = art.union_sources(run_parts)
    missing = sources.select("source_pos").join(runs.select("source_pos"), "source_pos", "left_anti").select(
        "source_pos",
        F.lit(False).alias("success"),
        F.lit("No payload landed").alias("error"),
        F.lit(None).cast("string").alias("source_title"),
    )
    return art.union_sources(article_parts), runs.unionByName(missing)


def edition_tables(new: DataFrame, runs: DataFrame, sources: DataFrame, fetched: DataFrame | None = None) -> dict[str, DataFrame]:
    """Edition tables of cleaned new articles.  ``fetched`` (src, filename) lists the images that exist, all when None."""
    section_table = edition.sections(new, runs, sources)
    chapters = edition.number_chapters(new, section_table)
    pages = edition.render_chapters(chapters)
    images = assets.collect(pages)
    on_disk = images if fetched is None else fetched
    toc = edition.toc(section_table, chapters)
    return {
        "sections": section_table,
        "chapters": assets.rewrite(pages, on_disk, ["chapter_no"]),
        "toc": toc,
        "spine": edition.spine(section_table, chapters),
        "dividers": edition.dividers(section_table, chapters),
        "nav": edition.render_nav(toc, section_table),
        "assets": images,
        "emoji": assets.unique_emoji(new, "content"),
        "run_summary": stats.run_summary(runs, new),
        "source_summary": stats.source_summary(runs, new, sources),
        "error_log": stats.error_log(runs, sources),
        "summary": edition.render_summary(runs, new, sources),
    }


def run(
    spark: SparkSession,
    config_path: str,
    landing: Landing,
    ledger_path: str,
    out_path: str,
    work_path: str,
    as_of: dt.datetime,
    run_id: int,
) -> bool:
    """One edition; False when nothing is new.

    The ledger is written last and without reading its own partition, so a repeated run gives the same edition.
    """
    edition_date = spark.range(1).select(dates.as_of_day(F.lit(as_of).cast("timestamp")).alias("d")).first()[0]
    sources, rejected = config.validate(config.read_config(spark, config_path), registry.types())
    bad = rejected.first()
    if bad is not None:
        raise config.ConfigError(f"body[{bad['source_pos']}]: {bad['reason']}")
    limit = config.read_limit(spark, config_path)
    found, runs = collect_sources(spark, sources, landing, limit, as_of)
    known = ledger.read(spark, ledger_path).filter(F.col("run_id") != run_id)
    stage = f"{work_path}/run_id={run_id}"
    ledger.with_ids(found).write.mode("overwrite").parquet(f"{stage}/found")
    fresh = ledger.new_articles(spark.read.parquet(f"{stage}/found"), known)
    art.clean(fresh, sources).write.mode("overwrite").parquet(f"{stage}/new")
    runs.write.mode("overwrite").parquet(f"{stage}/runs")
    new, runs = spark.read.parquet(f"{stage}/new"), spark.read.parquet(f"{stage}/runs")
    if not edition.has_new_content(new, runs):
        return False
    sinks.write_edition(edition_tables(new, runs, sources), out_path, edition_date)
    ordered = new.select("content_id", (F.col("source_pos").cast("bigint") * 2**32 + F.col("item_pos")).alias("ord"))
    ledger.append(spark, ordered, ledger_path, run_id)
    return True


def compact_ledger(spark: SparkSession, ledger_path: str, target_path: str, cap: int = fv.LEDGER_CAP) -> None:
    """Write the newest records to a new folder; the caller switches over once it is complete."""
    kept = ledger.compact(ledger.read(spark, ledger_path), cap)
    kept.write.mode("overwrite").partitionBy("run_id").parquet(target_path)
