"""Measures and text forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGGED, HIGH = 10, 20
# Keywords that count as operands.
VALUE_KEYWORDS = ("true", "false", "nullptr", "this")


def check_thresholds(flagged: int, high: int) -> None:
    if high < flagged:
        raise ValueError(f"the high threshold ({high}) is below the flagged one ({flagged})")


def rating(value: Column, flagged: int = FLAGGED, high: int = HIGH) -> Column:
    check_thresholds(flagged, high)
    return F.when(value > high, "high").when(value > flagged, "flagged").otherwise("ok")


def volume(n1: Column, n2: Column, t1: Column, t2: Column) -> Column:
    n = (n1 + n2).cast("double")
    return F.when(n < 2, F.lit(0.0)).otherwise((t1 + t2) * F.log2(n))


def difficulty(n1: Column, n2: Column, t2: Column) -> Column:
    return F.when(n2 == 0, F.lit(0.0)).otherwise(n1 * t2 / (F.lit(2.0) * F.when(n2 == 0, F.lit(1)).otherwise(n2)))


def effort(n1: Column, n2: Column, t1: Column, t2: Column) -> Column:
    return difficulty(n1, n2, t2) * volume(n1, n2, t1, t2)


def token_role(kind: Column, spelling: Column) -> Column:
    """operator, operand or not_counted."""
    return (
        F.when(kind == "comment", "not_counted")
        .when(kind.isin("identifier", "literal"), "operand")
        .when(kind == "keyword", F.when(spelling.isin(*VALUE_KEYWORDS), "operand").otherwise("operator"))
        .when(spelling.isin(")", "]", "}"), "not_counted")
        .otherwise("operator")
    )


def percent_or_zero(part: Column, all_: Column) -> Column:
    """Of documentation: 0 where there is nothing."""
    return F.when(all_ == 0, F.lit(0.0)).otherwise(F.try_divide(part * F.lit(100.0), all_))


def percent_or_null(part: Column, all_: Column) -> Column:
    """Of coverage: null where there is nothing."""
    return F.try_divide(part * F.lit(100.0), all_)


def percent_text(part: float, all_: float) -> str:
    """Of reports: n/a where there is nothing."""
    return "n/a" if not all_ else f"{100.0 * part / all_:.1f} %"


def percent_shown(part: Column, all_: Column) -> Column:
    """`percent_text` as a column."""
    return F.when(all_ == 0, "n/a").otherwise(F.concat(F.format_number(F.try_divide(part * F.lit(100.0), all_), 1), F.lit(" %")))


def doc_style(comment: Column) -> Column:
    doxygen = (comment.startswith("///") & ~comment.startswith("////")) | comment.startswith("//!") | (comment.startswith("/**") & ~comment.startswith("/**/")) | comment.startswith("/*!")
    return F.when(comment.isNull() | (comment == ""), "none").when(doxygen, "doxygen").otherwise("plain")


def csv_field(x: Column) -> Column:
    return F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def markdown_cell(x: Column) -> Column:
    return F.replace(x, F.lit("|"), F.lit("\\|"))


def dot_id(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
