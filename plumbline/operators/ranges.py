"""Range joins as one shuffle on the key and a running window, without comparing pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_gap(spans: DataFrame, marks: DataFrame, keys: list[str], begin: str, end: str, at: str) -> DataFrame:
    """spans with `gap_free`: no mark strictly between begin and end, as the largest mark below end isn't above begin.

    Repeated spans stay, each with its flag; one without a begin or an end is free.
    """
    s = spans.select(*keys, F.col(end).alias("_at"), F.struct(*spans.columns).alias("_span"))
    m = marks.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(s.schema["_span"].dataType).alias("_span"))
    return flagged_gaps(s.unionByName(m), keys, begin)


def flagged_gaps(rows: DataFrame, keys: list[str], begin: str) -> DataFrame:
    """with_gap of spans and marks in one table: keys, _at (a span's end or a mark's place), _span (null: a mark)."""
    before = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_span").isNull(), F.col("_at"))).over(before)
    out = rows.withColumn("_last", last).where(F.col("_span").isNotNull())
    return out.select("_span.*", F.coalesce(F.col("_last") <= F.col(f"_span.{begin}"), F.lit(True)).alias("gap_free"))


def gap_free(spans: DataFrame, marks: DataFrame, keys: list[str], begin: str, end: str, at: str) -> DataFrame:
    """Spans without a mark strictly between begin and end."""
    return with_gap(spans, marks, keys, begin, end, at).where("gap_free").drop("gap_free")


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, begin: str, end: str, strict: bool = False) -> DataFrame:
    """points with `covered`: how many ranges [begin, end) hold them, or (begin, end) if strict.

    Ranges open and close at their ends; a running sum over both and the points counts the open ones.
    """
    cols = points.columns
    p = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_rank"), F.lit(0).alias("_step"), F.struct(*cols).alias("_point"))
    none = F.lit(None).cast(p.schema["_point"].dataType).alias("_point")
    r = ranges.where(F.col(begin) < F.col(end))
    starts = r.select(*keys, F.col(begin).alias("_at"), F.lit(2 if strict else 0).alias("_rank"), F.lit(1).alias("_step"), none)
    ends = r.select(*keys, F.col(end).alias("_at"), F.lit(0).alias("_rank"), F.lit(-1).alias("_step"), none)
    running = Window.partitionBy(*keys).orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    out = p.unionByName(starts).unionByName(ends).withColumn("covered", F.sum("_step").over(running))
    return out.where(F.col("_point").isNotNull()).select("_point.*", "covered")


def _with_count(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, through: bool, name: str) -> DataFrame:
    """points with `name`: how many marks of the same keys stand below `at`, or at it too (through)."""
    p = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_rank"), F.lit(0).alias("_step"), F.struct(*points.columns).alias("_point"))
    m = marks.select(*keys, F.col(mark).alias("_at"), F.lit(0 if through else 2).alias("_rank"), F.lit(1).alias("_step"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"))
    running = Window.partitionBy(*keys).orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    out = p.unionByName(m).withColumn(name, F.sum("_step").over(running))
    return out.where(F.col("_point").isNotNull()).select("_point.*", name)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """left with `overlaps`: whether a range of right of the same keys has a.begin < b.end and b.begin < a.end.

    The number of right ranges that begin below a.end, less those that end at or below a.begin. Ranges of left must have
    begin <= end; repeated rows stay. Both counts run over one partitioning by the keys.
    """
    r = right.where(F.col(begin) < F.col(end))
    began = _with_count(left, r, keys, end, begin, False, "_began")
    return _with_count(began, r, keys, begin, end, True, "_ended").withColumn("overlaps", F.col("_began") > F.col("_ended")).drop("_began", "_ended")
