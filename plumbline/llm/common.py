"""What several operators share: the shared folder, written intermediate tables, bounded broadcasts, equal rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes, as read into memory, of a table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20

#: Rows of one key that a join leaves together; more are dealt over several tasks.
HOT = 2000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one is made only on a local master without the setting, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; its content goes when it is released, at the latest when the driver ends."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended already; nothing else depends on these files
            drop(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor loses none of it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for `released`."""
    return len(_written)


def released(since: int, *kept: DataFrame) -> None:
    """Drops the tables written since a mark, but for those that `kept` read: call it when what they led to is written."""
    keep = {f for df in kept for f in df.inputFiles()}
    gone = [(s, p) for s, p in _written[since:] if not any(_same(f, p) for f in keep)]
    for spark, path in gone:
        drop(spark, path)
        _written.remove((spark, path))


def _same(file: str, folder: str) -> bool:
    return folder.rsplit("/", 1)[-1] in file


def bytes_of(df: DataFrame) -> int:
    """How large df's rows are in memory, estimated from lengths over the whole (written) table: arrays, strings and all."""

    def size(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(t, T.ArrayType):
            flat = isinstance(t.elementType, T.NumericType)
            return F.coalesce(F.size(c) * 8, F.lit(0)) + 16 if flat else F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: (a + size(x, t.elementType)).cast("int")), F.lit(0)) + 16
        if isinstance(t, T.StructType):
            return sum((size(c[f.name], f.dataType) for f in t.fields), F.lit(8))
        return F.lit(8)

    each = sum((size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return int(df.agg(F.sum(each.cast("bigint"))).first()[0] or 0)


def bounded_broadcast(df: DataFrame, bound: int | None = None) -> DataFrame:
    """df, marked for broadcast if its rows take at most `bound` bytes. df should be a written table: it is measured."""
    return F.broadcast(df) if bytes_of(df) <= (BROADCAST_BYTES if bound is None else bound) else df


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """left joined with right on key; keys in hot (key, rows: its rows in left) are dealt over tasks by a hash of `by`.

    right has one row for each key; it is repeated once for every HOT rows of its key in left. hot should be written.
    """
    salts = bounded_broadcast(hot.select(key, F.ceil(F.col("rows") / F.lit(HOT)).cast("int").alias("salts")))
    at = F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))
    all_ = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
    dealt = left.join(salts, key, "left").withColumn("salt", at).drop("salts")
    repeated = right.join(salts, key, "left").withColumn("salt", F.explode(all_)).drop("salts")
    return dealt.join(repeated, [key, "salt"]).drop("salt")


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys of more than HOT rows, counted with partial sums: key, rows."""
    return written(df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT), "hot")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """128 bits of hash over a row's columns, null apart from any value: rows of equal keys are taken for equal.

    Types that can't be hashed (maps, variants) go in as JSON.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    odd = lambda f: any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if odd(f) else F.col(f"`{f.name}`") for f in fields]
    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{f.name}`").isNull(), "1").otherwise("0") for f in fields])
    return F.concat(F.hex(F.xxhash64(F.lit(1), nulls, *parts)), F.lit("-"), F.hex(F.xxhash64(nulls, *reversed(parts), F.lit(2))))


def collapsed(df: DataFrame, key: Column, key_name: str, copies: str) -> DataFrame:
    """df with one row of each set of equal rows, the key, and how many there are; only rows that repeat are shuffled.

    Sets of any size meet in partial aggregations. key says which rows are equal (see row_key).
    """
    keyed = df.withColumn(key_name, key)
    several = written(keyed.groupBy(key_name).agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1), "several")
    if several.isEmpty():
        return keyed.withColumn(copies, F.lit(1).cast("bigint"))
    known = bounded_broadcast(several.select(key_name))
    once = keyed.join(known, key_name, "left_anti").withColumn(copies, F.lit(1).cast("bigint"))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = keyed.join(known, key_name, "left_semi").groupBy(key_name).agg(F.first(whole).alias("w"), F.count(F.lit(1)).alias(copies))
    return once.unionByName(one.select("w.*", key_name, copies))


def expanded(df: DataFrame, copies: str, number: str | None = None) -> DataFrame:
    """Each row as often as `copies` says, numbered from 0; a row of many copies is dealt over tasks, HOT copies each."""
    chunk, salt = fresh(df, "chunk"), fresh(df, "chunk_salt")
    few = df.where(F.col(copies) <= HOT).withColumn(chunk, F.lit(0).cast("bigint"))
    many = df.where(F.col(copies) > HOT).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / HOT))))
    many = many.withColumn(salt, F.xxhash64(F.col(chunk), F.monotonically_increasing_id())).repartition(F.col(salt)).drop(salt)
    first = F.col(chunk) * HOT
    out = few.unionByName(many).where(F.col(copies) > 0)
    at = number or fresh(df, "copy_number")
    out = out.withColumn(at, F.explode(F.sequence(first, F.least(first + HOT, F.col(copies)) - 1))).drop(chunk)
    return out if number else out.drop(at)


def batched(items: list, size: int) -> Iterator[list]:
    for a in range(0, len(items), size):
        yield items[a : a + size]
