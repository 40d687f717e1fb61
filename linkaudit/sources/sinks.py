"""Results as files, written in parallel: one file per task, never through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_editorial_links(links: DataFrame, path: str, mode: str = "error") -> None:
    """The links kept by an editorial match, as CSV."""
    write_csv(links, path, mode)


def write_recommendations(recommendations: DataFrame, path: str, mode: str = "error") -> None:
    """The recommendation table, as CSV."""
    write_csv(recommendations, path, mode)


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """Each table of an audit as a Parquet folder of its name."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")
