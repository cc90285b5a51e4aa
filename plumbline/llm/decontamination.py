"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the number n of their distinct shingles into [2^p, 2^(p+1)). In each partition an item's
sketch is its k smallest shingle hashes (a bottom-k MinHash sketch), with k = floor((1 - t) * (2^(p+1) - 1)) + 1.
Hashes of more than HOT items (a phrase with which a third of them begin, say) come behind all others in that order, as
any order of hashes will do; items of equal shingles are searched for once.
A document that holds at least t * n of an item's shingles lacks at most (1 - t) * n < k of them, so it holds one of
the sketch at least: candidates lose nothing, however long the document is. A candidate is then checked by exact
containment of the shingle strings.

Words are runs of letters and digits, lower-cased. An item of fewer than `width` words is one shingle of all its words.

Defined cases: items without a word are never found; null or empty documents are clean; equal rows get equal results;
rows without a doc_id are judged by their own text; an item without an id, or of one that repeats, counts by its own
text; ids of either table may be of any type; empty tables give no rows; extra columns stay untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, HOT, bounded_broadcast, bytes_of, dealt_join, fresh, hot_keys, written

WIDTH, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, f) -> Column:
    """f(value), with the value made once: a filter that moves below a projection would else repeat it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _grams(words_: Column, width: int, item, empty: str) -> Column:
    """item(w, i) for each place i of the array at which `width` elements begin."""
    every = lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: item(w, i))).otherwise(F.array().cast(empty))
    return _let(words_, every)


def _hash_grams(hashes: Column, width: int) -> Column:
    return _grams(hashes, width, lambda h, i: F.xxhash64(*[h[i + j] for j in range(width)]), "array<bigint>")


def _text_grams(words_: Column, width: int) -> Column:
    return _grams(words_, width, lambda w, i: F.concat_ws(" ", *[w[i + j] for j in range(width)]), "array<string>")


def _items(benchmark: DataFrame, item_id: str, text: str, width: int, t: float) -> DataFrame:
    """item_id, w (words of a shingle), n, shingles (distinct), hashes, k (of them in the sketch), set_key (of the shingles)."""
    b = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("ws")).where("size(ws) > 0")
    b = b.select("item_id", F.least(F.size("ws"), F.lit(width)).alias("w"), "ws", F.transform("ws", lambda x: F.xxhash64(x)).alias("hs"))
    texts, hashes = F.lit(None).cast("array<string>"), F.lit(None).cast("array<bigint>")
    for w in range(1, width + 1):
        texts = F.when(F.col("w") == w, _text_grams(F.col("ws"), w)).otherwise(texts)
        hashes = F.when(F.col("w") == w, _hash_grams(F.col("hs"), w)).otherwise(hashes)
    b = b.select("item_id", "w", F.array_distinct(texts).alias("shingles"), F.array_distinct(hashes).alias("hashes")).withColumn("n", F.size("shingles"))
    part = F.floor(F.log2(F.col("n").cast("double")) + 1e-9)
    k = F.floor((1 - t + 1e-9) * (F.pow(F.lit(2.0), part + 1) - 1)).cast("int") + 1
    return b.select("item_id", "w", "n", "shingles", "hashes", k.alias("k"), F.sha2(F.array_join(F.array_sort("shingles"), "\n"), 256).alias("set_key"))


def _sketches(classes: DataFrame) -> DataFrame:
    """class, h: the sketch of each class of items. classes is written."""
    each = classes.select("class", F.explode("hashes").alias("h"))
    common = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("h"), "common")
    order = F.array_sort("hashes")
    if not common.isEmpty():
        late = each.join(bounded_broadcast(common), "h").groupBy("class").agg(F.collect_set("h").alias("late"))  # of one item
        classes = classes.join(late, "class", "left")
        last = F.coalesce("late", F.array().cast("array<bigint>"))
        order = F.concat(F.array_sort(F.array_except("hashes", last)), F.array_sort(last))
    return classes.select("class", F.explode(F.slice(order, F.lit(1), F.col("k"))).alias("h"))


def _held(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """id, text_hash, class, shared, n_shingles of the documents and the classes of which they hold enough; and the classes."""
    one = items.groupBy("set_key").agg(F.first(F.struct("w", "n", "shingles", "hashes", "k")).alias("c"))
    classes = written(one.select("set_key", "c.*").withColumn("class", F.monotonically_increasing_id()), "classes")
    widths = sorted(r[0] for r in classes.select("w").distinct().collect())  # at most as many as a shingle has words
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    if not widths:
        return d.select("id", "text_hash", F.lit(0).cast("bigint").alias("class"), F.lit(0).alias("shared"), F.lit(0).alias("n_shingles")).limit(0), classes
    sketch = written(_sketches(classes), "sketch")
    hashed = d.select("id", "text_hash", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("hs"))
    # the shingles of every width in one reading; those of another width than an item's are told apart by the check below
    grams = hashed.select("id", "text_hash", F.explode(F.concat(*[_hash_grams(F.col("hs"), w) for w in widths])).alias("h"))
    if bytes_of(sketch) <= BROADCAST_BYTES:
        hits = grams.join(F.broadcast(sketch), "h")
    else:  # a shingle that very many documents have is dealt over tasks
        hits = dealt_join(grams, sketch, "h", "text_hash", hot_keys(grams, "h"))
    candidates = written(hits.select("id", "text_hash", "class").distinct(), "candidates")
    c = candidates.select(F.col("id").alias("c_id"), F.col("text_hash").alias("c_hash"), "class")
    pairs = d.join(bounded_broadcast(c), (d.text_hash == F.col("c_hash")) & d.id.eqNullSafe(F.col("c_id")))
    pairs = pairs.join(bounded_broadcast(classes.drop("hashes", "k", "set_key")), "class")
    held = F.lit(None).cast("array<string>")
    for w in widths:
        held = F.when(F.col("w") == w, _text_grams(words(F.col("text")), w)).otherwise(held)
    pairs = pairs.select("id", "text_hash", "class", F.size(F.array_intersect("shingles", held)).alias("shared"), F.col("n").alias("n_shingles"))
    least = math.ceil(threshold * 1000)
    return pairs.where(F.col("shared") * 1000 >= F.col("n_shingles") * least).distinct(), classes


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document row's (id, text hash) and item of which it holds enough: id, text_hash, item_id, shared, n_shingles."""
    items = written(_items(benchmark, item_id, item_text, width, threshold), "items")
    found, classes = _held(docs, items, id_col, text_col, threshold)
    members = written(items.select("item_id", "set_key").distinct().join(classes.select("set_key", "class"), "set_key").select("class", "item_id"), "members")
    return found.join(bounded_broadcast(members), "class").select("id", "text_hash", "item_id", "shared", "n_shingles").distinct()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns and other rows as they were."""
    items = _items(benchmark, item_id, item_text, width, threshold)
    bad = written(_held(docs, items, id_col, text_col, threshold)[0].select("id", "text_hash").distinct(), "contaminated")
    a, b = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = bounded_broadcast(bad.toDF(a, b))
    return docs.join(bad, (F.xxhash64(docs[text_col]) == bad[b]) & docs[id_col].eqNullSafe(bad[a]), "left_anti")


def oracle_sql(width: int = WIDTH, threshold: float = THRESHOLD) -> str:
    """Brute force in DuckDB over every document and item."""
    toks = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    grams = "list_transform(range(1, len(ws) - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' '))"
    return f"""WITH b0 AS (SELECT item_id, {toks} AS ws FROM benchmark),
    b1 AS (SELECT item_id, ws, least(len(ws), {width}) AS w FROM b0 WHERE len(ws) > 0),
    b AS (SELECT DISTINCT item_id, w, unnest({grams}) AS g FROM b1),
    n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
    d0 AS (SELECT doc_id, {toks} AS ws FROM documents),
    d1 AS (SELECT doc_id, ws, unnest([{', '.join(str(i) for i in range(1, width + 1))}]) AS w FROM d0),
    d AS (SELECT DISTINCT doc_id, w, unnest({grams}) AS g FROM d1 WHERE len(ws) >= w AND w IN (SELECT w FROM b1))
    SELECT doc_id, item_id, count(*)::int AS shared, any_value(n)::int AS n_shingles
    FROM d JOIN b USING (w, g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 1000 >= any_value(n) * {math.ceil(threshold * 1000)}"""
