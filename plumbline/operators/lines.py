"""Line kinds and line counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.cfront import lexer
from ..sources.dealing import dealt
from .stats import TOTAL

KINDS = ("blank", "comment", "code")


def kinds_udf():
    """content -> the kind of each line, by Arrow batches. Comments and literals run over lines, so no column expression will do."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def kinds(content: pd.Series) -> pd.Series:
        return content.map(lambda c: lexer.line_kinds(bytes(c)) if c is not None else [])

    return kinds


def counts_udf():
    """content -> blank, comment, code: three numbers leave the worker, not a value for each line."""

    @F.pandas_udf("blank bigint, comment bigint, code bigint")
    def counts(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lexer.line_counts(c) if c is not None else (0, 0, 0) for c in content], columns=list(KINDS))

    return counts


def line_table(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """file, line (from 1), kind."""
    c = F.col(content).cast("binary")
    return dealt(files).select(F.col(path).alias("file"), F.posexplode(kinds_udf()(c)).alias("line", "kind")).withColumn("line", F.col("line") + 1)


def line_counts(files: DataFrame, *keep: Column, path: str = "path", content: str = "content") -> DataFrame:
    """file, physical, blank, comment, code; a file of no lines has zeros. One row a file: no line leaves its task."""
    k = dealt(files).select(F.col(path).alias("file"), *keep, counts_udf()(F.col(content).cast("binary")).alias("_k"))
    k = k.select("file", *[c for c in k.columns if c not in ("file", "_k")], (F.col("_k.blank") + F.col("_k.comment") + F.col("_k.code")).alias("physical"), *[f"_k.{x}" for x in KINDS])
    return k


def total(counts: DataFrame) -> DataFrame:
    whole = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("physical", *KINDS)])
    return whole.select(F.lit(TOTAL).alias("file"), "physical", *KINDS)
