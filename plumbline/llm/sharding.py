"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of their key columns. The numbers go through a keyed permutation of 0..n-1 (a Feistel
network on the next power of two, walked until it falls below n). Position p has shard p mod s and slot p div s, so
shards' counts differ by one at most, slots have no gaps, and a row's place follows from its number alone.

Rows are numbered without gathering them: equal keys are counted first, the distinct keys are range-partitioned and
written, and each partition starts at the sum of the partitions before it.

Defined cases: null keys come first; rows with equal keys share a run of positions, so repeated rows are all placed;
null texts have size 8; an empty table gives no rows; extra columns, of any type and name, stay with their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collapsed, dealt_join, fresh, hot_keys, row_key, shared_dir, written

SHARDS, SEED, ROUNDS = 24, 2024, 6


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply) as round function."""
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The place of each x in a permutation of 0..n-1 that seed chooses."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), np.uint64(seed))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(x.astype(np.uint64))
        while (far := out >= np.uint64(n)).any():  # cycle walking: a permutation of the larger range leads back
            out[far] = once(out[far])
    return out.astype(np.int64)


def shard_keys(keys: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """keys' columns, position, shard and slot for each row; all columns of `keys` together order the rows."""
    cols, n_col = keys.columns, fresh(keys, "row_count")
    return _numbered(keys.groupBy(*cols).agg(F.count(F.lit(1)).alias(n_col)), cols, n_col, shards, seed)


def _places(counted: DataFrame, shards: int, seed: int) -> DataFrame:
    """counted (i, k, n: rows of the key) ordered by i and k, with a row for each place of a key."""
    return _numbered(counted, ["i", "k"], "n", shards, seed)


def _numbered(runs: DataFrame, cols: list[str], n_col: str, shards: int, seed: int) -> DataFrame:
    """cols, position, shard and slot of each row that runs (cols, and how many rows of them) stand for."""
    spark = runs.sparkSession
    shared_dir(spark)  # so that checkpoint() has its folder
    pid_col = fresh(runs, "part_id")
    runs = runs.select(*cols, n_col)
    runs = runs.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in cols]).sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_first() for c in cols])
    runs = runs.checkpoint()  # fixes which rows a partition has
    runs = runs.withColumn(pid_col, F.spark_partition_id())
    sizes = {r[0]: r[1] for r in runs.groupBy(pid_col).agg(F.sum(n_col)).collect()}  # one row for each partition
    starts, total = {}, 0
    for pid in sorted(sizes):
        starts[pid], total = total, total + sizes[pid]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = starts[batch.column(pid_col)[0].as_py()] if at is None else at
            ends = np.cumsum(batch.column(n_col).to_numpy(zero_copy_only=False))
            kept = batch.select(cols)
            for a in range(0, int(ends[-1]), 100_000):  # a run of equal rows may be far longer than a batch
                number = np.arange(a, min(a + 100_000, int(ends[-1])))
                p = permute(number + at, total, seed)
                rows = kept.take(pa.array(np.searchsorted(ends, number, side="right")))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p), pa.array((p % shards).astype("int32")), pa.array(p // shards)], [*cols, "position", "shard", "slot"])
            at += int(ends[-1])

    extra = [T.StructField("position", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    return runs.mapInArrow(place, T.StructType([*(f for f in runs.schema.fields if f.name in cols), *extra]))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a shard and a slot. Rows are numbered by id, then by a hash of the whole row.

    Equal rows are interchangeable: they are collapsed to one with a count, which takes a run of places and is copied to
    each, a long run dealt over tasks. So whole rows cross one shuffle, to meet their places, and no key is gathered.
    """
    i, k, n = (fresh(docs, x) for x in ("place_id", "place_key", "place_copies"))
    one = collapsed(docs, row_key(docs), k, n)
    at = docs.select(F.col(f"`{id_col}`").alias("i"), row_key(docs).alias("k")).groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"))  # no texts
    places = written(_places(at, shards, seed).select(F.col("k").alias(k), F.col("shard").alias("s"), F.col("slot").alias("t")), "places")
    names = {"shard": fresh(docs, "shard"), "slot": fresh(docs, "slot")}
    rows = one.drop(n).withColumnRenamed(k, i)
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(i).alias(k))
    out = dealt_join(places, rows, k, "t", hot_keys(places, k))
    return out.select("row.*", F.col("s").alias(names["shard"]), F.col("t").alias(names["slot"]))
