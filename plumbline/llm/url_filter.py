"""URL filter: host and path rules, and a Bloom filter cascade over the corpus's complete key universe.

Keys are hosts and their parent domains. Level 0 encodes the listed keys of the universe; level 1 encodes the other
keys that level 0 wrongly holds; level 2 the listed keys that level 1 wrongly holds, and so on until no key is wrong.
A key's membership is the parity of the first level that lacks it. As every key of the corpus went into the building,
the answer is exact, and judging a page needs no join: executors make a level's bits in segments, and they go to the
tasks with the plan, as one constant however often they are looked at.

A list too long for its bits to stand in a plan is judged in slices of the keys by hash, a cascade and a pass over
the pages' hosts for each; the method is the same.

Defined cases: a null url or one without "://" has an empty host and path and is allowed; an empty list or table
gives no levels; equal rows give equal verdicts; extra columns are ignored; the url may stand in any column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mark, released, written

#: verdict, host, path prefix
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The list that the query judges by: a host a line.
BLOCKLIST = Path(__file__).with_name("blocklist.txt")
#: Bits of all levels together that may stand in a plan at once (32 MiB: about twenty million listed keys).
SLICE_BITS = 1 << 28
#: 64-bit words of a segment: what one task makes of a level at a time.
SEGMENT = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, "[.]")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    """m bits, one constant of the plan; k hash functions."""

    bits: Column
    m: int
    k: int
    seed: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.m)) for i in range(self.k)]

    def holds(self, key: Column) -> Column:
        """Whether all places of key are set."""
        out = F.lit(True)
        for p in self.places(key):
            byte = F.conv(F.hex(F.substring(self.bits, (F.shiftright(p, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
            out = out & (byte.bitwiseAND(F.call_function("shiftright", F.lit(128), (p % 8).cast("int"))) != 0)
        return out


def _shape(n: int, p: float) -> tuple[int, int]:
    """Bits (whole segments) and hash functions for n keys at a false positive rate of p."""
    bits = math.ceil(n * math.log(1 / p) / math.log(2) ** 2)
    return max(1, -(-bits // (64 * SEGMENT))) * 64 * SEGMENT, max(1, round(math.log2(1 / p)))


def _encode(keys: DataFrame, n: int, p: float, seed: int) -> Level:
    """The level of keys. Words of 64 bits are made by a pre-aggregated grouping, segments of words by another; only
    the finished segments come to the driver, m / 8 bytes in all."""
    m, k = _shape(n, p)
    empty = Level(F.lit(None), m, k, seed)
    places = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("b"))
    # bit 0 of a word is its highest, so that the words' hexadecimal digits are the bytes in order
    words = places.groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (63 - F.col("b") % 64).cast("int"))).alias("v"))
    none = keys.sparkSession.range(m // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("v"))
    words = words.union(none).groupBy("w").agg(F.bit_or("v").alias("v"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", F.lpad(F.hex("v"), 16, "0").alias("h")))), lambda x: x["h"]), "")
    segments = words.groupBy(F.floor(F.col("w") / SEGMENT).alias("segment")).agg(F.unhex(text).alias("bytes"))
    bits = b"".join(bytes(r["bytes"]) for r in segments.orderBy("segment").collect())  # m / 8 bytes, bounded by SLICE_BITS
    return Level(F.lit(bits), m, k, seed)


def _rate(r: int, s: int) -> float:
    """The first level's false positive rate that makes all levels together smallest."""
    return min(0.5, max(1e-6, r / (math.sqrt(2) * max(s, 1))))


def universe_of(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """key, on: every key of the universe once, and whether it is listed (one column, key, each)."""
    marked = universe.select("key").distinct().join(listed.select("key").distinct().withColumn("on", F.lit(True)), "key", "left")
    return written(marked.select("key", F.coalesce("on", F.lit(False)).alias("on")), "universe")


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels for the keys that are on against all others (see universe_of; a written table)."""
    inside, outside = keys.where("on").select("key"), keys.where("not on").select("key")
    r, s = inside.count(), outside.count()
    levels: list[Level] = []
    p = _rate(r, s)
    while r:
        levels.append(_encode(inside, r, p, len(levels)))
        wrong = written(outside.where(levels[-1].holds(F.col("key"))), "wrong")
        inside, outside = wrong, inside
        r, p = wrong.count(), 0.5
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the parity of the first level that lacks it."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", slice_bits: int = SLICE_BITS) -> DataFrame:
    """id, host, path, rule (the longest that fits, else null), listed (by the cascade), verdict."""
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"), F.lit(False).alias("listed"))
    begun = mark()
    keys = universe_of(listed, p.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")))
    r, s = keys.where("on").count(), keys.where("not on").count()
    # the first level's bits, and about 1.5 bits a key for the others
    slices = max(1, -(-int(_shape(max(r, 1), _rate(r, s))[0] + 3 * r) // slice_bits))
    for n in range(slices):
        mine = (lambda k, n=n: F.pmod(F.xxhash64(k, F.lit("slice")), F.lit(slices)) == n) if slices > 1 else (lambda k: F.lit(True))
        levels = build_cascade(keys.where(mine(F.col("key"))))
        p = p.withColumn("listed", F.col("listed") | F.exists(keys_of(F.col("host")), lambda k: mine(k) & member(levels, k)))  # noqa: B023  (called at once)
        if slices > 1:  # one slice's bits in a plan at a time
            p = written(p, "judged")
            released(begun, p, keys)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for what, host, path in sorted(rules, key=lambda x: (len(x[1] + x[2]), x)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return p.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


def listed_keys(spark: SparkSession, path: str | None = None, column: str = "key") -> DataFrame:
    """key: the hosts of a list. path names a Parquet table with that column, or a text file of a host a line (# begins a
    comment); without it, the list beside this module."""
    if path is None:
        lines = [x.split("#")[0].strip() for x in BLOCKLIST.read_text().splitlines()]
        return spark.createDataFrame([(x,) for x in lines if x], "key string")
    if path.rstrip("/").endswith(".parquet"):
        keys = spark.read.parquet(path).select(F.col(column).cast("string").alias("key"))
    else:
        keys = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("key"))
    return keys.select(F.translate("key", UPPER, LOWER).alias("key")).where("key <> ''").distinct()


def oracle_sql(rules=RULES) -> str:
    listed = [x for x in BLOCKLIST.read_text().split() if x]
    fit = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    ordered = sorted(rules, key=lambda x: (len(x[1] + x[2]), x), reverse=True)
    bad = " OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in listed)
    return f"""WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a)
    SELECT page_id, host, path, CASE {' '.join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in ordered)} END AS rule,
    CASE {' '.join(f"WHEN {fit(h, p)} THEN '{w}'" for w, h, p in ordered)} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict, ({bad}) AS listed FROM b"""
