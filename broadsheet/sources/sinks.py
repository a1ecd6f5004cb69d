"""Edition tables on disk, one partition per edition date."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_edition(tables: dict[str, DataFrame], path: str, edition_date: str) -> None:
    """Write every table under ``path/<name>``; writing an edition again replaces only that edition."""
    for name, table in tables.items():
        # the partition's own folder: an empty table replaces its rows, too
        table.write.mode("overwrite").parquet(f"{path}/{name}/edition_date={edition_date}")
