"""Distribution statistics by group and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import FLAGGED, HIGH, check_thresholds

TOTAL = "TOTAL"


def describe_columns(value: str, flagged: int = FLAGGED, high: int = HIGH) -> list[Column]:
    """count, mean, median (of the middle two), p90 (nearest rank), max, flagged, high; all 0 for nothing."""
    check_thresholds(flagged, high)
    v, zero = F.col(value), F.lit(0)
    return [
        F.count(v).alias("count"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.coalesce(F.median(v), F.lit(0.0)).alias("median"),
        F.coalesce(F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY `{value}`)").cast("bigint"), zero).alias("p90"),
        F.coalesce(F.max(v).cast("bigint"), zero).alias("max"),
        F.count_if(v > flagged).alias("flagged"),
        F.count_if(v > high).alias("high"),
    ]


def describe(df: DataFrame, keys: list[str], value: str, *more: Column, flagged: int = FLAGGED, high: int = HIGH) -> DataFrame:
    return df.groupBy(*keys).agg(*describe_columns(value, flagged, high), *more)


def with_total(df: DataFrame, key: str, aggregate, total: str = TOTAL) -> DataFrame:
    """aggregate(df, keys) by key, and once more for all rows under the key `total` (a row even if df is empty).

    The total comes from the rows themselves, as medians of groups don't add up.
    """
    whole = aggregate(df, []).withColumn(key, F.lit(total)).withColumn("is_total", F.lit(True))
    return aggregate(df, [key]).withColumn("is_total", F.lit(False)).unionByName(whole)


def describe_with_total(df: DataFrame, key: str, value: str, *more: Column, flagged: int = FLAGGED, high: int = HIGH) -> DataFrame:
    return with_total(df, key, lambda d, k: describe(d, k, value, *more, flagged=flagged, high=high))
