"""Module rows: facts grouped by one key, joined fully, and a total of the same shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import percent_or_zero
from .coverage import COLUMNS
from .stats import TOTAL, describe_columns

LINES = ("physical", "code", "comment", "blank")


def _files(files: DataFrame, keys: list[str]) -> DataFrame:
    """files: module, is_test, parsed and LINES."""
    sums = lambda test, c: F.coalesce(F.sum(F.when(F.col("is_test") == test, F.col(c))), F.lit(0))
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("parsed").alias("files_parsed"),
        *[sums(False, c).alias(f"production_{c}") for c in LINES], *[sums(True, c).alias(f"test_{c}") for c in LINES],
    )


def _functions(functions: DataFrame, keys: list[str], flagged: int, high: int) -> DataFrame:
    """functions: module, is_test, complexity, volume, effort. Test code doesn't count for the product."""
    d = functions.where("not is_test").groupBy(*keys).agg(*describe_columns("complexity", flagged, high), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"halstead_{c}") for c in ("volume", "effort")])
    names = {"count": "functions"} | {c: f"complexity_{c}" for c in ("mean", "median", "p90", "max")}
    return d.withColumnsRenamed(names)


def _api(api: DataFrame, keys: list[str], full: bool) -> DataFrame:
    return api.where("not is_test").groupBy(*keys).agg(F.count(F.lit(1)).alias("api"), F.count_if("documented").alias("documented"), *([F.count_if("doxygen").alias("doxygen")] if full else []))


def _coverage(coverage: DataFrame, keys: list[str]) -> DataFrame:
    return coverage.where("not is_test").groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"coverage_{c}") for c in COLUMNS])


ZERO = ["files", "files_parsed", *[f"production_{c}" for c in LINES], *[f"test_{c}" for c in LINES], "functions", "complexity_mean", "complexity_median", "complexity_p90", "complexity_max", "flagged", "high", "halstead_volume", "halstead_effort", "api", "documented"]
COVERED = [f"coverage_{c}" for c in COLUMNS]
ROW = [
    "module", "files", "files_parsed", "production_physical", "production_code", "production_comment", "production_blank", "test_physical", "test_code", "functions", "complexity_mean", "complexity_median",
    "complexity_p90", "complexity_max", "flagged", "high", "halstead_volume", "halstead_effort", "api", "documented", "documented_percent", *COVERED, "fan_in", "fan_out", "cycle",
]


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    if keys:
        return reduce(lambda a, b: a.join(b, keys, "full"), parts)
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def module_rows(files: DataFrame, functions: DataFrame, api: DataFrame, coverage: DataFrame | None, graph: DataFrame | None, flagged: int = 10, high: int = 20, full: bool = False) -> DataFrame:
    """One row for each module known to any fact or to the graph (module, fan_in, fan_out, cycle), and TOTAL.

    With coverage data, a module without a record has zeros; one that only the graph knows stays null there. The
    total's statistics come from the facts themselves; its graph columns are null. full adds what only the JSON document shows.
    """

    zero = [*ZERO, *(["doxygen"] if full else [])]

    def rows(keys: list[str]) -> DataFrame:
        parts = [_files(files, keys), _functions(functions, keys, flagged, high), _api(api, keys, full)]
        if coverage is not None:
            parts.append(_coverage(coverage, keys))
        out = _joined(parts, keys).fillna(0, [*zero, *(COVERED if coverage is not None else [])])
        return out if coverage is not None else out.withColumns({c: F.lit(None).cast("bigint") for c in COVERED})

    nothing = {"fan_in": F.lit(None).cast("bigint"), "fan_out": F.lit(None).cast("bigint"), "cycle": F.lit(None).cast("bigint")}
    each, whole = rows(["module"]), rows([]).withColumn("module", F.lit(TOTAL))
    each = each.join(graph, "module", "full").fillna(0, zero) if graph is not None else each.withColumns(nothing)
    each, whole = each.withColumn("is_total", F.lit(False)), whole.withColumns(nothing).withColumn("is_total", F.lit(True))
    out = each.unionByName(whole).withColumn("documented_percent", percent_or_zero(F.col("documented"), F.col("api")))
    return out.select(*ROW, "is_total", *(["test_comment", "test_blank", "doxygen"] if full else []))
