"""Dealing rows over tasks before costly work on each row, where the files at hand would leave most tasks idle."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame


def _splits(path: str, enough: int) -> int:
    """How many tasks can read a file: its row groups, if it is Parquet that can be looked into from here."""
    import pyarrow.parquet as pq

    at = urlsplit(path)
    if at.scheme not in ("", "file") or not at.path.endswith(".parquet"):
        return enough
    try:
        return pq.read_metadata(unquote(at.path)).num_row_groups
    except (OSError, ValueError):
        return enough


def dealt(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as it is where its files can keep every core busy; else its rows are shuffled over the cores.

    A table of many files or row groups isn't touched, so no large input pays for a shuffle of its contents: the shuffle
    is of at most as many row groups as there are cores.
    """
    enough = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= enough or sum(_splits(f, enough) for f in files) >= enough:
        return df
    return df.repartition(2 * enough, by) if by else df.repartition(2 * enough)
