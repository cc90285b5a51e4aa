"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of its documents: total * weight / documents. A document's count is the
inverse of the Poisson distribution at a number in [0, 1) made of its hash; the document is exploded by its count, and
the copies are shuffled over the whole output by another hash.

The hash is of id, text and occurrence: rows of equal ids and other texts are drawn apart, and so are equal rows, which
are counted rather than gathered (see common.collapsed).

Defined cases: a null source is a source of its own; a source without a target weight gets no copies; a null id counts
as an id apart from any other, a null text as another than the empty one; null and empty texts are copied as any; empty
tables give none; the copies keep all columns, of any type and name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bytes_of, collapsed, expanded, fresh, row_key, written

SEED, POWER = "mix-1", 0.7


def poisson_cdf(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until the rest is below what a number of 52 bits can tell."""
    if rate <= 0:
        return []
    top = int(rate + 12 * rate**0.5 + 30)
    k = np.arange(top + 1)
    cdf = np.cumsum(np.exp(k * np.log(rate) - rate - np.array([lgamma(i + 1.0) for i in k])))
    return np.minimum(cdf[: int(np.searchsorted(cdf, 1 - 2.0**-52)) + 1], 1.0).tolist()


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) of 52 bits, made of a hash of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _let(value: Column, f) -> Column:
    """f(value), with the value made once, however often f looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source_col: str = "source", power: float = POWER) -> DataFrame:
    """mix_source, documents, rate, cdf of each source. Without weights, a source weighs its count to the given power."""
    counts = written(docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("documents")), "sources")
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("documents").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()) or [(None, 0.0)], "w_source string, weight double")
        weighted = counts.join(given, F.col("mix_source").cast("string").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"])
    n, w = weighted.agg(F.sum("documents"), F.sum("weight")).first()
    goal, w = float(total if total is not None else n or 0), w or 1.0

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["rate"] = goal * pdf["weight"] / w / pdf["documents"]
            yield pdf.drop(columns="weight").assign(cdf=[poisson_cdf(r) for r in pdf["rate"]])

    kind = dict(counts.dtypes)["mix_source"]
    return written(weighted.mapInPandas(table, f"mix_source {kind}, documents bigint, rate double, cdf array<double>"), "rates")


def _with_rates(docs: DataFrame, table: DataFrame, names: dict[str, str], source_col: str) -> DataFrame:
    """docs with their sources' rates. Where the distributions take more than a broadcast may, only the large sources'
    go by it, at most as many as fit; those of few documents each are joined by a shuffle on the source, none of them hot."""
    source = names["mix_source"]
    rows = max(1, table.count())
    if bytes_of(table) <= BROADCAST_BYTES:
        return docs.join(F.broadcast(table), docs[source_col].eqNullSafe(table[source])).drop(source)
    most = max(1, BROADCAST_BYTES * rows // (2 * bytes_of(table)))
    counts = docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    large = written(counts.orderBy(F.desc("n"), "s").limit(most).select(F.col("s").alias(fresh(docs, "large_source"))), "large")
    is_large = lambda c: c.eqNullSafe(large[large.columns[0]])
    of_large = table.join(F.broadcast(large), is_large(table[source]), "left_semi")
    few = docs.join(F.broadcast(large), is_large(docs[source_col]), "left_anti")
    rest = table.join(F.broadcast(large), is_large(table[source]), "left_anti")
    out = docs.join(F.broadcast(of_large), docs[source_col].eqNullSafe(of_large[source])).drop(source)
    return out.unionByName(few.join(rest, few[source_col].eqNullSafe(rest[source])).drop(source))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, details: bool = False) -> DataFrame:
    """The copies, with docs' columns, and with details=True mix_copy, mix_copies and mix_rate beside them."""
    names = {x: fresh(docs, x) for x in ("mix_source", "mix_rate", "mix_cdf", "mix_copies", "mix_copy", "mix_key", "mix_order", "mix_equal", "mix_times", "mix_number")}
    table = rates(docs, weights, total, source_col)
    table = table.select(F.col("mix_source").alias(names["mix_source"]), F.col("rate").alias(names["mix_rate"]), F.col("cdf").alias(names["mix_cdf"]))
    one = expanded(collapsed(docs, row_key(docs), names["mix_equal"], names["mix_times"]), names["mix_times"], names["mix_number"])
    out = _with_rates(one, table, names, source_col)
    said = lambda c, none: F.coalesce(F.md5(F.col(c).cast("string")), F.lit(none))
    key = F.concat(said(id_col, "none"), F.lit(":"), said(text_col, "none"), F.lit(":"), F.col(names["mix_number"]).cast("string"))

    def drawn(k: Column) -> Column:
        """A (copy, copies, order) for each copy of the document of this key."""
        count = _let(uniform(k, seed), lambda u: F.size(F.filter(F.col(names["mix_cdf"]), lambda c: c <= u)))
        each = lambda n: F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.struct(i.alias("copy"), n.alias("copies"), F.xxhash64(F.lit(seed), k, i).alias("order")))
        return _let(count, each)

    out = out.withColumn(names["mix_key"], F.explode(_let(key, drawn)))
    parts = {"mix_copy": "copy", "mix_copies": "copies", "mix_order": "order"}
    out = out.withColumns({names[k]: F.col(names["mix_key"])[v] for k, v in parts.items()})
    shown = [F.col(f"`{c}`") for c in docs.columns] + [F.col(names[x]) for x in ("mix_copy", "mix_copies", "mix_rate")] * details
    return out.repartition(F.col(names["mix_order"])).sortWithinPartitions(names["mix_order"]).select(*shown)


def oracle_sql(seed: str = SEED, power: float = POWER) -> str:
    return f"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    t AS (SELECT sum(n)::double AS total, sum(pow(n::double, {power})) AS w FROM c),
    r AS (SELECT source, total * pow(n::double, {power}) / w / n AS rate FROM c, t),
    p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, range(0, 60) AS s(k)),
    o AS (SELECT doc_id, source, coalesce(md5(doc_id::varchar), 'none') || ':' || coalesce(md5(text), 'none') || ':' || (row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1) AS key FROM documents),
    u AS (SELECT doc_id, source, key, ('0x' || substr(md5('{seed}:' || key), 1, 13))::bigint / {float(1 << 52)} AS u FROM o),
    k AS (SELECT u.doc_id, u.source, u.key, count(*) AS copies FROM u JOIN p ON p.source IS NOT DISTINCT FROM u.source AND p.cdf <= u.u GROUP BY ALL)
    SELECT doc_id, source, unnest(range(1, copies + 1))::int AS copy, copies::int AS copies FROM k"""
