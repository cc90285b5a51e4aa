"""Documentation of public declarations: attachment, containment, and its share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import doc_style, percent_or_zero
from .ranges import flagged_gaps, in_ranges, with_gap
from .stats import with_total


def attach(declarations: DataFrame, siblings: DataFrame, keys: list[str]) -> DataFrame:
    """declarations (keys, begin, comment, comment_end, trailing) with `style`.

    A trailing comment always belongs; one before belongs unless a sibling's name (keys, name_at) stands strictly
    between the comment's end and the declaration's start. Rows stay as they are: those that begin at one place, as the
    names of `int a, b;` do, and repeated ones too.
    """
    return _styled(with_gap(declarations, siblings, keys, "comment_end", "begin", "name_at"))


def attach_first(rows: DataFrame, keys: list[str], place: list[str], order: list[str]) -> DataFrame:
    """`attach` over rows of both kinds, which are read once: each declaration as the first of its place (keys, place)
    by order, which must tell all of a place apart; each sibling's name once.

    rows: keys, place (null of a name), name_at (null of a declaration), declaration (a struct of all its columns; null
    of a name).
    """
    first = F.min_by("declaration", F.struct(*[F.col(f"declaration.{c}") for c in order])).alias("_span")
    once = rows.groupBy(*keys, *place, "name_at").agg(first)
    return _styled(flagged_gaps(once.select(*keys, F.coalesce("name_at", "_span.begin").alias("_at"), "_span"), keys, "comment_end"))


def _styled(out: DataFrame) -> DataFrame:
    free = F.col("trailing") | F.col("gap_free")
    return out.withColumn("style", F.when(F.col("comment").isNull() | free, doc_style(F.col("comment"))).otherwise("none")).drop("gap_free")


def not_contained(types: DataFrame, typedefs: DataFrame, keys: list[str], at: str = "begin", begin: str = "begin", end: str = "end") -> DataFrame:
    """Types that don't stand strictly inside a typedef."""
    return in_ranges(types, typedefs, keys, at, begin, end, strict=True).where("covered = 0").drop("covered")


def doc_summary(api: DataFrame, key: str = "module") -> DataFrame:
    """entities, documented, percent (0 of nothing), doxygen by key and TOTAL; api has documented and doxygen flags."""

    def aggregate(d: DataFrame, keys: list[str]) -> DataFrame:
        out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("entities"), F.count_if("documented").alias("documented"), F.count_if("doxygen").alias("doxygen"))
        return out.withColumn("percent", percent_or_zero(F.col("documented"), F.col("entities")))

    return with_total(api, key, aggregate)
