"""First-wins deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys, the first by order, which must tell them all apart.

    An aggregation rather than a window: the map side keeps one row for each key, so a key of many rows isn't gathered.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*[F.col(c) for c in order + rest]), F.struct(*order)) if rest else F.min(F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("first_row")).select(*keys, "first_row.*").select(*df.columns)

