"""MinHash near-duplicates with sequential Bayesian verification.

1. A document's set is its distinct word shingles, as 64-bit hashes. Equal sets (128-bit digest) form one class, so
   exact copies count once from here on.
2. A class has a signature of SIGNATURE minimum hashes, kept as their low bytes. The first BANDS * ROWS of them make
   bands; classes that agree in a band are candidates. A pair at the threshold 0.8 misses every band with a
   probability of (1 - 0.8^6)^42 < 3e-6.
3. In the first wave each class is compared with one pivot (of the buckets it shares, the member with the most
   neighbours), and the two of each bucket of two with each other. In the second wave the larger buckets that still
   hold different components are compared, in blocks of bounded size; pairs inside one component are skipped and a
   bucket's largest component isn't compared with itself, so a group of copies isn't expanded into all its pairs.
   Where blocks would cost a bucket more copies of its rows than it has bands (members that share a passage, say), it is
   parted by BANDS bands of the signature's other half; a pair that meets in such a bucket only is missed with a
   probability of 3e-6 more. Parts are compared in blocks too, whatever their size.
4. Comparing is sequential: signatures are compared in batches, and a pair is dropped as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold falls below MISS.
5. Survivors are verified on the full sets. The second wave's are verified within their block, whose rows with a
   survivor get their full sets for that: only links that join two components of the block leave it, fewer than it has
   rows, so what leaves doesn't grow with the square of a group. Components of the verified links are the groups.

Defined cases: documents without words, or null, have an empty set and link with nothing; with fewer words than a
shingle, all words make one; rows of equal ids are linked by their own texts; a null id takes part, but a component's
id is the smallest id that isn't null; ids may be of any type that has an order; texts are read whole; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dealing import dealt
from .common import HOT, bounded_broadcast, dealt_join, fresh, hot_keys, mark, released, written
from .components import components

THRESHOLD = 0.8
BANDS, ROWS, SIGNATURE = 42, 6, 504
#: The posterior below which a pair is dropped, at each of 14 looks. A pair of similarity exactly 0.8 is then lost with a
#: probability below 1e-5 over all looks, one of 0.82 below 1e-6 (see test_bayesian_bounds).
BATCH, MISS = 36, 5e-7
#: Members of a bucket that one task compares with as many others at once; one of more than LONG shingles counts for
#: several, so that a block's full sets take about BLOCK * LONG * 8 bytes (16 MB) at most.
BLOCK, LONG = 512, 4096
#: Members of a bucket beside its largest component from which it is parted by the bands of the other half.
WIDE = BANDS * BLOCK
WORDS_KNOWN = 300_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text. bytes.lower() and split() know only ASCII."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    return np.unique(out)


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1))
    return rng.integers(0, 1 << 31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


def signature(hashes: np.ndarray) -> bytes:
    a, b = _multipliers()
    x = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    low = None
    for i in range(0, len(x), 512):
        part = np.multiply.outer(a, x[i : i + 512])
        part += b[:, None]
        m = part.min(axis=1)
        low = m if low is None else np.minimum(low, m)
    # the low bits of a minimum are spread before a byte is kept
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(n: int, threshold: float, miss: float = MISS) -> int:
    """Of n compared bytes, the fewest equal ones at which P(similarity >= threshold) is still miss or more."""
    j = np.linspace(0, 1, 2001)
    p = np.clip(j + (1 - j) / 256, 1e-12, 1 - 1e-12)
    upper = j >= threshold - 1e-9
    for m in range(n + 1):
        log = m * np.log(p) + (n - m) * np.log(1 - p)
        w = np.exp(log - log.max())
        if w[upper].sum() / w.sum() >= miss:
            return m
    return n + 1


@cache
def _bounds(threshold: float) -> tuple[tuple[int, int, int], ...]:
    return tuple((a, min(a + BATCH, SIGNATURE), least_matches(min(a + BATCH, SIGNATURE), threshold)) for a in range(0, SIGNATURE, BATCH))


def surviving(s: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (s[i], t[j]) survive the sequential comparison: places in i and j."""
    left, same = np.arange(len(i)), np.zeros(len(i), np.int32)
    for a, b, least in _bounds(threshold):
        same = same + (s[i[left], a:b] == t[j[left], a:b]).sum(axis=1, dtype=np.int32)
        keep = same >= least
        left, same = left[keep], same[keep]
        if not len(left):
            break
    return left


def document_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), set_digest, sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            ns, digests, sigs = [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), width, known)
                ns.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sigs.append(signature(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "set_digest", "sig"])

    d = dealt(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, n bigint, set_digest binary, sig binary")


def _with_both(pairs: DataFrame, of_u: DataFrame, of_v: DataFrame) -> DataFrame:
    """pairs (written; u, v) with the rows of both ends; a pivot of many pairs is dealt over several tasks."""
    one = dealt_join(pairs, of_u, "u", "v", hot_keys(pairs, "u"))
    return dealt_join(one, of_v, "v", "u", hot_keys(pairs, "v"))


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame | None:
    """node, members: the full sets of the classes in nodes (distinct); None if there are none."""
    need = written(nodes.join(classes.select("node", "first_id", "set_digest"), "node"), "needed")
    if not need.count():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [shingles(t.as_py(), width, known) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["set_digest", "members"])

    ids = bounded_broadcast(need.select(F.col("first_id").alias("need_id")).distinct())
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = d.join(ids, F.col("id").eqNullSafe(F.col("need_id")), "left_semi").select("text")
    sets = texts.mapInArrow(run, "set_digest binary, members array<bigint>").join(bounded_broadcast(need.select("node", "set_digest")), "set_digest").select("node", "members")
    return written(sets.dropDuplicates(["node"]), "sets")  # rows of one class have equal sets: any of them will do


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) of classes whose full sets are similar enough."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = _sets(nodes, classes, docs, width, id_col, text_col)
    if sets is None:
        return pairs.select("u", "v")
    both = _with_both(pairs.select("u", "v"), sets.toDF("u", "mu"), sets.toDF("v", "mv"))
    shared = F.size(F.array_intersect("mu", "mv"))
    return both.select("u", "v", shared.alias("s"), (F.size("mu") + F.size("mv")).alias("t")).where(F.col("s") * 100 >= percent * (F.col("t") - F.col("s"))).select("u", "v")


def _pivots(shared: DataFrame, hot: DataFrame) -> DataFrame:
    """u, v: each class and, of the buckets it is in, the member with the most neighbours; and the members of buckets of two."""
    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    at = shared.join(weight, "node")
    top = at.groupBy("band_key").agg(F.max(F.struct("weight", "node")).alias("top"))
    best = dealt_join(at.select("node", "band_key"), top, "band_key", "node", hot).groupBy("node").agg(F.max("top").alias("top"))
    star = best.select(F.col("node").alias("u"), F.col("top.node").alias("v")).where("u <> v")
    twos = shared.where("members = 2").groupBy("band_key").agg(F.min("node").alias("u"), F.max("node").alias("v")).select("u", "v")
    return star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(twos).distinct()


def _compare_pivots(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("su", "sv"))
            i = np.arange(batch.num_rows)
            yield batch.select(["u", "v"]).take(pa.array(surviving(s, t, i, i, threshold)))

    c = classes.select("node", "sig", "n")
    both = _with_both(pairs, c.toDF("u", "su", "nu"), c.toDF("v", "sv", "nv"))
    both = both.where(F.least("nu", "nv") >= F.greatest("nu", "nv") * F.lit(threshold - 1e-9))
    return both.select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def _mixed(at: DataFrame) -> DataFrame:
    """Of the buckets that hold several components: band_key, largest (component), n (its members), total.

    A member of more than LONG shingles counts for several.
    """
    sizes = at.groupBy("band_key", "component").agg(F.sum(F.ceil(F.col("n") / F.lit(LONG))).alias("n"))
    top = sizes.groupBy("band_key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total")).where("top.n < total")
    return top.select("band_key", F.col("top.component").alias("largest"), F.col("top.n").alias("n"), "total")


def _parts(at: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets, in each of the parts that the bands of the signature's other half make of a bucket."""
    second = f"substring(sig, {BANDS * ROWS} + b * {ROWS} + 1, {ROWS})"
    keys = F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(band_key, b, {second}))")).alias("part", "part_key")
    parts = at.join(classes.select("node", "sig"), "node").select("node", "n", "band", "component", keys)
    return parts.select("node", "n", "band", "part", F.col("part_key").alias("band_key"), "component")


def _compare_buckets(shared: DataFrame, classes: DataFrame, labels: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """Rows of blocks that have a surviving pair of different components (see _block_rows, _partners); each pair is
    tested in its first bucket only.

    A bucket's largest component needs no comparing within itself. The other members, the rest, are cut into blocks
    0..r-1 and the largest component into blocks from r on; a task compares one block of the rest with another block,
    so a bucket of one large group and few others costs a copy or two of each row. A bucket of up to BLOCK members is
    one block. One of more than WIDE others is parted first (see _parts).
    """
    at = shared.where("members > 2").join(labels, "node", "left").select("node", "n", "band", F.lit(-1).alias("part"), "band_key", F.coalesce("component", "node").alias("component"))
    top = written(_mixed(at), "mixed")
    is_wide = F.col("total") - F.col("n") > WIDE
    if top.where(is_wide).isEmpty():
        return _near_rows(_block_rows(at, top, classes, hot), threshold)
    wide = top.where(is_wide).select("band_key")
    parts = written(_parts(dealt_join(at, wide, "band_key", "node", hot), classes), "parts")
    one = _near_rows(_block_rows(at, top.where(~is_wide), classes, hot), threshold)
    return one.union(_near_rows(_block_rows(parts, written(_mixed(parts), "mixed"), classes, hot_keys(parts, "band_key")), threshold))


def _block_rows(at: DataFrame, top: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """The members of the buckets of top, or of parts of buckets (part is -1 for a whole bucket), in each comparison of two
    blocks (lo, hi) that they take part in."""
    blocks = lambda rows: F.ceil(rows / F.lit(BLOCK)).cast("int")
    small = F.col("total") <= BLOCK  # one block of all members: two tasks would cost more than they spare
    r, g = F.when(small, 1).otherwise(blocks(F.col("total") - F.col("n"))), F.when(small, 0).otherwise(blocks(F.col("n")))
    top = top.select("band_key", "largest", r.alias("r"), g.alias("g"))
    at = dealt_join(at.drop("n"), top, "band_key", "node", hot).join(classes.select("node", "sig", "n"), "node")
    rest, h = (F.col("component") != F.col("largest")) | (F.col("g") == 0), F.xxhash64("node")
    at = at.withColumn("own", F.when(rest, F.pmod(h, F.col("r"))).otherwise(F.col("r") + F.pmod(h, F.col("g"))).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(rest, F.col("r") + F.col("g")).otherwise(F.col("r")) - 1)))
    return at.select("node", "component", "band", "part", "band_key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "sig", "n")


def _partners(pdf: pd.DataFrame, threshold: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """For the rows of two blocks, a function of a row and the rows' labels: the rows of other labels that make a
    surviving pair with it. It gives a pair for one of its rows only."""
    node, n = (pdf[c].to_numpy() for c in ("node", "n"))
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, SIGNATURE)
    band, part, one = int(pdf["band"].iloc[0]), int(pdf["part"].iloc[0]), pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
    codes = np.zeros((2, len(sig), BANDS, 8), np.uint8)
    codes[:, :, :, :ROWS] = sig.reshape(-1, 2, BANDS, ROWS).swapaxes(0, 1)
    bands, others = codes.view(np.uint64)[..., 0]
    first = pdf["own"].to_numpy() == pdf["lo"].iloc[0]

    def partners(i: int, label: np.ndarray) -> np.ndarray:
        if not (one or first[i]):
            return np.empty(0, np.int64)
        ok = (label != label[i]) & (np.minimum(n, n[i]) >= np.maximum(n, n[i]) * (threshold - 1e-9))
        ok &= node > node[i] if one else ~first
        j = np.flatnonzero(ok)
        # a pair that shares an earlier band was tested there for certain if it shares one of the other half too, in
        # which a wide bucket is parted; within a part it does
        if len(j) and band:
            met = (bands[j, :band] == bands[i, :band]).any(axis=1)
            if part < 0:
                met[met] = (others[j[met]] == others[i]).any(axis=1)
            j = j[~met]
        if len(j) and part > 0:
            j = j[~(others[j, :part] == others[i, :part]).any(axis=1)]
        return j[surviving(sig, sig, np.full(len(j), i), j, threshold)] if len(j) else j

    return partners


def _near_rows(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows of _block_rows that have a surviving pair in their comparison."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        partners, component, near = _partners(pdf, threshold), pdf["component"].to_numpy(), np.zeros(len(pdf), bool)
        for i in range(len(pdf)):
            j = partners(i, component)
            near[j] = True
            near[i] |= len(j) > 0
        return pdf[near]

    return rows.groupBy("band_key", "lo", "hi").applyInPandas(run, rows.schema)


def _links(pdf: pd.DataFrame, threshold: float, percent: int) -> tuple[list[int], list[int]]:
    """Rows of two blocks, with their full sets, that are linked: of the verified links only those that join two
    components, given or made by the links before, so there are fewer than rows."""
    partners, label, n = _partners(pdf, threshold), pdf["component"].to_numpy(copy=True), pdf["n"].to_numpy()
    codes = np.unique(np.concatenate(pdf["members"].to_list()), return_inverse=True)[1]
    sets, held = np.split(codes, np.cumsum(n)[:-1]), np.zeros(codes.max() + 1, bool)
    us, vs = [], []
    for i in range(len(pdf)):
        j = partners(i, label)
        if not len(j):
            continue
        held[sets[i]] = True
        shared = np.add.reduceat(held[np.concatenate([sets[k] for k in j])], np.cumsum(n[j]) - n[j], dtype=np.int64)
        held[sets[i]] = False
        for k in j[shared * 100 >= percent * (n[i] + n[j] - shared)]:
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                us.append(i)
                vs.append(k)
    return us, vs


def _linked(near: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """u, v: links, verified on the full sets, that join the components of the rows of each comparison (_near_rows)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        us, vs = _links(pdf, threshold, percent)
        return pd.DataFrame({"u": node[us], "v": node[vs]}, dtype="int64")

    return near.join(sets, "node").groupBy("band_key", "part", "lo", "hi").applyInPandas(run, "u bigint, v bigint")


def _grouped(docs: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (see document_sets), and set_digest, first_id, component of each class."""
    begun = mark()
    percent = round(threshold * 100)
    rows = written(document_sets(docs, width, id_col, text_col), "rows")
    classes = rows.where("n > 0").groupBy("set_digest").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    bands = classes.select("node", "n", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {ROWS} + 1, {ROWS})))")).alias("band", "band_key"))
    full = written(bands.groupBy("band_key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    hot = written(full.where(F.col("members") > HOT).select("band_key", F.col("members").alias("rows")), "hot")
    shared = written(dealt_join(bands, full, "band_key", "node", hot), "shared")
    pairs = written(_pivots(shared, hot), "pivots")
    links = written(_verified(written(_compare_pivots(pairs, classes, threshold), "pivoted"), classes, docs, width, percent, id_col, text_col), "links")
    labels = components(links)
    near = written(_compare_buckets(shared, classes, labels, hot, threshold), "near")
    sets = _sets(near.select("node").distinct(), classes, docs, width, id_col, text_col)
    if sets is not None:
        labels = components(links.union(written(_linked(near, sets, threshold, percent), "links")))
    named = written(classes.join(labels, "node", "left").select("set_digest", "first_id", F.coalesce("component", "node").alias("component")), "named")
    released(begun, rows, named)
    return rows, named


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept, set_digest for each row."""
    rows, named = _grouped(docs, width, threshold, id_col, text_col)
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    # only classes that aren't alone with their own id need a join with the rows
    named = named.join(least, "component").select("set_digest", "component_id", F.col("first_id").alias("own_id"))
    out = rows.select("id", "n", "set_digest").join(named, "set_digest", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.col("n") == 0).alias("kept"), "set_digest")


def _numbered(docs: DataFrame, number: str, digest: str, order: str, width: int, text_col: str) -> DataFrame:
    """docs, written, with a number, the set's digest (null without words) and a hash of the text and the other columns."""

    @F.pandas_udf("binary")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Words()
        for texts in batches:
            sets = (shingles(t, width, known) for t in texts)
            yield pd.Series([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets], dtype=object)

    plain = [F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    hashes = F.struct(F.xxhash64(text_col), F.xxhash64(*plain))
    return written(docs.withColumns({number: F.monotonically_increasing_id(), digest: digests(text_col), order: hashes}), "again")


def deduplicate(docs: DataFrame, width: int = 5, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each group: of the class with the smallest id, or else (no row of the group has an
    id, or ids are equal) with the smallest digest, the row of that id; of several such rows the first by a hash.

    Ids may repeat or be null; a row is judged by its own text. Rows without words belong to no group and stay.
    """
    rows, named = _grouped(docs, width, threshold, id_col, text_col)
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "set_digest")).alias("s")
    winners = named.groupBy("component").agg(first).select("s.set_digest", F.col("s.first_id").alias("win_id"), F.lit(1).alias("won"))
    winners = written(winners, "winners")
    # rows of an id, and how many of them stay: rows of one id and one set count together before they meet the winners
    sets = rows.groupBy("id", "set_digest").agg(F.count(F.lit(1)).alias("n")).join(winners.withColumnRenamed("set_digest", "win_set"), F.expr("set_digest = win_set and id <=> win_id"), "left")
    stays = F.when(F.col("set_digest").isNull(), F.col("n")).otherwise(F.coalesce("won", F.lit(0)))
    ids = written(sets.groupBy("id").agg(F.sum("n").alias("n"), F.sum(stays).alias("k")).where("k < n"), "surplus")

    gone, number, digest, order = (fresh(docs, x) for x in ("gone_id", "row_number", "row_digest", "row_order"))
    key = F.col(id_col)
    drop = written(ids.where("k = 0 and id is not null").select(F.col("id").alias(gone)), "gone")
    out = docs.join(bounded_broadcast(drop), key == F.col(gone), "left_anti")
    several = written(ids.where("k > 0 or id is null").select(F.col("id").alias(gone)), "several")
    if not several.count():
        return out
    known = bounded_broadcast(several)
    alone = out.join(known, key.eqNullSafe(F.col(gone)), "left_anti")
    again = _numbered(out.join(known, key.eqNullSafe(F.col(gone)), "left_semi"), number, digest, order, width, text_col)
    slim = again.where(F.col(digest).isNotNull()).groupBy(key.alias("id"), F.col(digest).alias("set_digest")).agg(F.min(F.struct(order, number)).alias("s"))
    slim = slim.join(winners.withColumnRenamed("set_digest", "win_set"), F.expr("set_digest = win_set and id <=> win_id")).select(F.col(f"s.{number}").alias(gone))
    slim = bounded_broadcast(written(slim, "kept"))
    kept = again.where(F.col(digest).isNull()).unionByName(again.where(F.col(digest).isNotNull()).join(slim, F.col(number) == F.col(gone), "left_semi"))
    return alone.unionByName(kept.drop(number, digest, order))


def oracle_sql(width: int = 4, percent: int = 80) -> str:
    """Brute force in DuckDB: all pairs that share a shingle, and the transitive closure of the links."""
    grams = f"CASE WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    t AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY ws) AS first FROM w),
    g AS (SELECT DISTINCT doc_id, unnest({grams}) AS s FROM t WHERE doc_id = first AND len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
    m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT t.doc_id, coalesce(n, 0)::bigint AS n_shingles, coalesce(m.b, t.doc_id) AS component_id, coalesce(m.b, t.doc_id) = t.doc_id AS kept
    FROM t LEFT JOIN n ON n.doc_id = t.first AND len(ws) > 0 LEFT JOIN m ON m.a = t.first AND len(ws) > 0"""
