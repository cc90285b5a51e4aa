"""Merging, attributing and summing test coverage.

Hits are reduced to hit or not as early as can be: only that is ever used, and sums of counters can't overflow.
A long table has path, entity (line, branch, function), line, id, hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import percent_or_null
from .stats import with_total

KINDS = ("line", "branch", "function")
NAMES = {"line": "lines", "branch": "branches", "function": "functions"}
COLUMNS = [c for k in KINDS for c in (NAMES[k], f"{NAMES[k]}_covered")]


def branch_id(source: Column, destination: Column, position: Column) -> Column:
    return F.coalesce(F.concat(source.cast("string"), F.lit(">"), destination.cast("string")), position.cast("string"))


def merge(hits: DataFrame) -> DataFrame:
    """Counts for each path: entities, and those hit in any record."""
    each = hits.groupBy("path", "entity", "line", "id").agg(F.bool_or(F.col("hits") > 0).alias("covered"))
    return each.groupBy("path").agg(*[c for k in KINDS for c in (F.count_if(F.col("entity") == k).alias(NAMES[k]), F.count_if((F.col("entity") == k) & F.col("covered")).alias(f"{NAMES[k]}_covered"))])


def with_totals(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts and a tool's own totals by path; a path twice in totals, or in both, is an error. All-zero totals don't count."""
    some = totals.where(" or ".join(f"{c} <> 0" for c in COLUMNS))
    both = counts.select("path", *COLUMNS, F.lit(0).alias("own")).unionByName(some.select("path", *COLUMNS, F.lit(1).alias("own")))
    out = both.groupBy("path").agg(*[F.sum(c).alias(c) for c in COLUMNS], F.count(F.lit(1)).alias("n"), F.sum("own").alias("own"))
    bad = (F.col("n") > 1) & (F.col("own") > 0)
    clash = F.raise_error(F.concat(F.lit("coverage of one file from two sources that can't be merged: "), F.col("path")))
    return out.select(F.when(bad, clash).otherwise(F.col("path")).alias("path"), *COLUMNS)


def attribute(counts: DataFrame, path: Column, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Counts added up by mapped path, inside the project; and the number of paths outside."""
    mapped = counts.withColumns({"file": path, "_inside": inside})
    return mapped.where("_inside").groupBy("file").agg(*[F.sum(c).alias(c) for c in COLUMNS]), mapped.agg(F.count_if(~F.col("_inside")).alias("outside"))


def summary(files: DataFrame, key: str = "module") -> DataFrame:
    def aggregate(d: DataFrame, keys: list[str]) -> DataFrame:
        out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COLUMNS])
        return out.withColumns({f"{k}_percent": percent_or_null(F.col(f"{NAMES[k]}_covered"), F.col(NAMES[k])) for k in KINDS})

    return with_total(files, key, aggregate)
