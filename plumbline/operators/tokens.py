"""Complexity and Halstead counts of token arrays, without a shuffle: a function's tokens stay on its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import token_role

# What counts as a decision where the scanner has confirmed the construct.
DECISIONS = ("if", "for", "while", "do", "case", "catch", "&&", "||", "?")


def complexity(tokens: Column) -> Column:
    """1 and the confirmed decisions (field construct)."""
    return F.size(F.filter(tokens, lambda t: t["construct"].isin(*DECISIONS))) + 1


COUNTS = ("distinct_operators", "distinct_operands", "total_operators", "total_operands")


def with_halstead(df: DataFrame, tokens: str) -> DataFrame:
    """df with COUNTS of its array of (kind, spelling); zeros for a null or empty array.

    Each token's role is found once, as a letter before its spelling; distinct ones are hashed within the row.
    """
    mark = lambda t: F.when(token_role(t["kind"], t["spelling"]) == "operator", F.concat(F.lit("+"), t["spelling"])).when(token_role(t["kind"], t["spelling"]) == "operand", F.concat(F.lit("-"), t["spelling"]))
    marked = df.withColumn("_marked", F.transform(tokens, mark))
    both = marked.withColumn("_once", F.array_distinct("_marked"))
    of = lambda c, sign: F.coalesce(F.size(F.filter(c, lambda x: x.startswith(sign))), F.lit(0)).cast("bigint")
    some = F.col("_marked").isNotNull()
    counts = [of("_once", "+"), of("_once", "-"), of("_marked", "+"), of("_marked", "-")]
    return both.withColumns({k: F.when(some, c).otherwise(0) for k, c in zip(COUNTS, counts, strict=True)}).drop("_marked", "_once")


def halstead_by(df: DataFrame, keys: list[str], kind: str, spelling: str) -> DataFrame:
    """The same of a table of tokens, for tokens that aren't on one row."""
    role = token_role(F.col(kind), F.col(spelling))
    each = df.select(*keys, role.alias("_r"), F.col(spelling).alias("_s")).groupBy(*keys, "_r", "_s").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*keys).agg(
        *[F.count_if(F.col("_r") == r).alias(f"distinct_{r}s") for r in ("operator", "operand")],
        *[F.coalesce(F.sum(F.when(F.col("_r") == r, F.col("_n"))), F.lit(0)).alias(f"total_{r}s") for r in ("operator", "operand")],
    )
