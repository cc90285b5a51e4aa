"""Reports' top lists, with the order of ties made explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLEXITY, EFFORT, UNDOCUMENTED, FAN, CELLS = 20, 10, 50, 10, 20


def top(df: DataFrame, k: int, measure: str, *ties: Column | str) -> DataFrame:
    return df.orderBy(F.desc(measure), *ties).limit(k)


def shown(df: DataFrame, k: int) -> DataFrame:
    """shown and all: min(n, k) of n."""
    return df.agg(F.least(F.count(F.lit(1)), F.lit(k).cast("bigint")).alias("shown"), F.count(F.lit(1)).alias("all"))
