"""Document fingerprints: a canonical exact digest.

A text is normalised (NFKC), case-folded, and its white space folded to single spaces; its fingerprint is a 128-bit
xxhash of the result. Documents of equal fingerprints are grouped and their canonical bytes compared, so a group never
rests on the hash alone: texts that differ inside a bucket get fingerprints with a suffix.

Defined cases: null texts count as empty, and empty ones have the fingerprint of the empty text; texts are read whole;
rows of equal ids are ordered by a hash of their text; null ids come last, ordered so too; equal rows follow each other;
an empty table gives no rows; extra columns are ignored; an id that isn't an integer is a TypeError, as the order of
documents is that of numbers. Likeness is 1 for equal canonical texts, else 0.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_broadcast, collapsed, dealt_join, expanded, hot_keys, mark, released, row_key, written

#: Ranges of ids for each shuffle partition: their bounds, 16 bytes each, are sent to tasks.
RANGES = 8
COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def hash128(raw: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(raw)


def canonical(text: str) -> str:
    folded = text if text.isascii() else unicodedata.normalize("NFKC", text)
    folded = folded.casefold()
    if not folded.isascii():
        folded = unicodedata.normalize("NFKC", folded)
    return " ".join(folded.split())


def canonical_bytes(text: str) -> bytes:
    return canonical(text).encode("utf-8", "surrogatepass")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def collisions(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, hasher: Callable[[bytes], str]) -> DataFrame:
    """fingerprint, canonical text and rank of buckets whose canonical bytes differ. (id, fingerprint) are in prints.

    Only documents that share a bucket are read again, and equal texts meet in the map-side aggregation already; the
    rows of a large bucket are dealt over tasks.
    """
    shared = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    ids = dealt_join(prints.select("id", "fingerprint"), shared, "fingerprint", "id", hot_keys(prints, "fingerprint"))
    ids = written(ids.select(F.col("id").alias("c_id")).distinct(), "shared")

    @F.pandas_udf("canon string, fingerprint string")
    def both(texts: pd.Series) -> pd.DataFrame:
        canon = [canonical(t or "") for t in texts]
        return pd.DataFrame({"canon": canon, "fingerprint": [hasher(c.encode("utf-8", "surrogatepass")) for c in canon]})

    same = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(bounded_broadcast(ids), F.col("id").eqNullSafe(F.col("c_id")), "left_semi")
    same = same.select(both("text").alias("b")).select("b.*").distinct()
    several = same.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    texts = same.join(F.broadcast(written(several, "several")), "fingerprint")  # buckets of two texts: a hash of 128 bits has none
    return texts.groupBy("fingerprint").agg(F.collect_set("canon").alias("texts")).select("fingerprint", F.posexplode(F.array_sort("texts")).alias("rank", "canon"))


class _Ranges:
    """The order of documents, cut into ranges: ids downwards, rows of one id by the hash of their text, null ids last.

    An id of more rows than a range should have is a range by itself, cut further by the hash, and so are null ids.
    """

    def __init__(self, rows: DataFrame, partitions: int):
        n = RANGES * partitions
        ids = rows.select("id")
        total, nulls = ids.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
        most = max(1, -(-total // n))
        cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] if total > nulls else None
        # ids of many rows show as several cuts at one place; at most n of them
        cuts = np.array(cuts or [], dtype="int64")
        heavy = np.unique(cuts[1:][cuts[1:] == cuts[:-1]])
        sizes = {r["id"]: r["n"] for r in ids.where(F.col("id").isin([int(x) for x in heavy])).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()} if len(heavy) else {}
        top = np.iinfo(np.int64).max
        self.cuts = np.unique(np.concatenate([cuts, heavy, heavy[heavy < top] + 1]).astype("int64"))
        parts = np.ones(len(self.cuts) + 2, np.int64)  # ranges from the largest ids on, null ids last
        for i, size in sizes.items():
            parts[self._of(np.array([i]))[0]] = -(-size // most)
        parts[-1] = max(1, -(-nulls // most))
        self.parts, self.start = parts, np.concatenate([[0], np.cumsum(parts)[:-1]])

    def _of(self, ids: np.ndarray) -> np.ndarray:
        return len(self.cuts) - np.searchsorted(self.cuts, ids, side="right")

    def of(self):
        """The range of (id, whether it is null, hash of the text)."""
        cuts, parts, start, place = self.cuts, self.parts, self.start, self._of

        @F.pandas_udf("int")
        def at(ids: pd.Series, none: pd.Series, tie: pd.Series) -> pd.Series:
            r = np.where(none.to_numpy(bool), len(cuts) + 1, place(ids.to_numpy("int64")))
            # the upper 32 bits of the hash, as an order from 0
            part = ((tie.to_numpy("int64") >> np.int64(32)) + np.int64(1 << 31)) * parts[r] >> np.int64(32)
            return pd.Series((start[r] + part).astype("int32"))

        return at(F.coalesce("id", F.lit(0)), F.col("id").isNull(), F.col("tie"))


def document_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Callable[[bytes], str] = hash128) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller id. Ids are cut into ranges; each text goes once to its range, and
    the first of a range also to the range before it in that order, so no task needs another's rows. Equal rows go as
    one with a count. hasher makes the fingerprint of canonical bytes.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer to order documents by, not {kind.simpleString()}")
    begun = mark()
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = collapsed(d, row_key(d), "same", "copies").drop("same")
    keys = written(d.select("id", F.xxhash64("text").alias("tie")), "keys")
    ranges = _Ranges(keys, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the first row of each range by (id downwards, hash upwards): ~tie falls as tie rises
    heads = keys.withColumn("at", ranges.of()).groupBy("at").agg(F.max(F.struct("id", (-1 - F.col("tie")).alias("t"))).alias("h")).select("at", "h.id", (-1 - F.col("h.t")).alias("tie")).collect()  # one row for each range
    filled = sorted(heads, key=lambda r: r["at"])
    if not filled:
        return docs.select(F.col(id_col)).limit(0).mapInPandas(lambda it: it, f"{id_col} bigint").select(id_col, *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in COLUMNS.split(", "))])
    # the first row of a range, and the range before it, which needs that row too; after the last comes the first
    small = spark.createDataFrame([(b["id"], b["tie"], a["at"]) for a, b in zip(filled, filled[1:] + filled[:1], strict=True)], "head_id bigint, head_tie bigint, borrower int")

    def pass_(ranks: dict[bytes, int]) -> DataFrame:
        t = d.withColumn("tie", F.xxhash64("text")).withColumn("at", ranges.of())
        t = t.join(F.broadcast(small), t.id.eqNullSafe(small.head_id) & (t.tie == small.head_tie), "left")
        own = F.struct(F.col("at"), F.lit(0).alias("lent"))
        t = t.select("id", "text", "tie", "copies", F.explode(F.when(F.col("borrower").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("borrower").alias("at"), F.lit(1).alias("lent"))))).alias("to"))
        t = t.select("id", "text", "tie", "copies", "to.at", "to.lent").repartition("at").sortWithinPartitions("at", "lent", F.desc_nulls_last("id"), "tie")

        def digest(raw: bytes) -> str:
            rank = ranks.get(raw, 0)
            return hasher(raw) + (f"-{rank}" if rank else "")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None  # a row that waits for the next one: range, id, text, lent, copies, canonical bytes, digest

            def out(row, text, raw, print_):
                """The result of row beside a next text with these canonical bytes and digest."""
                new = edited(row[2], text)
                new_raw = canonical_bytes(new)
                return (row[1], len(row[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), row[6], digest(new_raw), float(new_raw == row[5]), float(raw == row[5]))

            for pdf in batches:
                rows = []
                for id_, text, at_, lent, copies in zip(pdf["id"], pdf["text"], pdf["at"], pdf["lent"], pdf["copies"], strict=True):
                    raw = canonical_bytes(text)
                    row = (at_, id_, text, lent, copies, raw, digest(raw))
                    if held is not None and not held[3] and held[0] == at_:
                        rows.append((*out(held, text, raw, row[6]), 1))
                    if not lent and copies > 1:  # all but the last of equal rows are followed by their like
                        rows.append((*out(row, text, raw, row[6]), copies - 1))
                    if not (lent and held is not None and held[3] and held[0] == at_):
                        held = row
                yield pd.DataFrame(rows, columns=["id", *[x.split()[0] for x in COLUMNS.split(", ")], "times"])

        made = t.withColumn("id", F.col("id").cast("string")).mapInPandas(run, f"id string, {COLUMNS}, times bigint")
        return written(made.withColumn("id", F.col("id").cast("bigint")), "prints")

    prints = pass_({})
    clash = written(collisions(docs, prints, id_col, text_col, hasher), "collisions")
    ranks = {r["canon"].encode("utf-8", "surrogatepass"): r["rank"] for r in clash.where("rank > 0").collect()}  # texts that share a hash with another
    if ranks:
        prints = pass_(ranks)
    out = expanded(prints, "times").select(F.col("id").alias(id_col), *[x.split()[0] for x in COLUMNS.split(", ")])
    released(begun, prints)
    return out
