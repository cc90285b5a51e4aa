"""Readers of coverage data: tracefiles, and two JSON forms, told apart by their content.

Each gives the long table path, entity, line, id, hits; the JSON form with a tool's own totals gives counts by path.
A table of (source, text) comes in: `spark.read.text(..., wholetext=True)` with the file name, or any DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normal
from ..operators.coverage import COLUMNS, branch_id

HITS = "decimal(20,0)"
LLVM_MARK, GCOV_MARK = '"llvm.coverage.json.export"', '"format_version"'
GCOV = (
    "current_working_directory string, files array<struct<file string, functions array<struct<name string, demangled_name string, execution_count decimal(20,0)>>,"
    " lines array<struct<line_number bigint, count decimal(20,0), branches array<struct<count decimal(20,0), source_block_id bigint, destination_block_id bigint>>>>>>"
)
_PAIR = "struct<count bigint, covered bigint>"
LLVM = f"data array<struct<files array<struct<filename string, summary struct<lines {_PAIR}, branches {_PAIR}, functions {_PAIR}>>>>>"


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths), wholetext=True).select(_source(), F.col("value").alias("text"))


def _source() -> Column:
    return F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("source")


def read_files(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """read_coverage of files. JSON is read whole, tracefiles record by record, so that a large one is read by many tasks."""
    json, lines = [], []
    for p in paths:
        head = _head(p)
        (json if head.startswith("{") else lines).append(p)
        if not head.startswith("{") and "SF:" not in head and spark.read.text(p).where(F.col("value").contains("SF:")).isEmpty():
            raise ValueError(f"{p}: no coverage records")
    none = spark.createDataFrame([], "source string, text string")
    hits, totals = read_coverage(read_texts(spark, *json) if json else none)
    if lines:
        records = spark.read.option("lineSep", "\nend_of_record").text(lines).select(_source(), F.col("value").alias("text"))
        hits = hits.unionByName(lcov(records))
    return hits, totals


def _head(path: str, size: int = 1 << 16) -> str:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    with store.open_input_stream(at, compression=None) as f:
        return f.read(size).decode("utf-8", "replace").removeprefix("\ufeff").lstrip()


def sniff(text: Column) -> Column:
    """lcov, gcov or llvm; other JSON is an error."""
    json = F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith("{")
    return F.when(json & text.contains(LLVM_MARK), "llvm").when(json & text.contains(GCOV_MARK), "gcov").when(json, F.raise_error(F.lit("a JSON file that isn't coverage data"))).otherwise("lcov")


def _resolved(path: Column, base: Column) -> Column:
    return normal(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def _number(x: Column, least: int, what: Column) -> Column:
    n = x.try_cast("bigint") if hasattr(x, "try_cast") else F.expr(f"try_cast({x} as bigint)")
    return F.when(n.isNull() | (n < least), F.raise_error(F.concat(F.lit("not a number that fits: "), what))).otherwise(n)


def lcov(texts: DataFrame, base: Column | None = None) -> DataFrame:
    """Line protocol: SF opens a file, end_of_record closes it; DA, BRDA, FN, FNDA and FNA count, other records don't.

    A text is cut before each SF and end_of_record, so that each piece carries its file's name in its first line: no
    record needs what stands in another row, and a tracefile may come in pieces that end before an end_of_record.
    """
    pieces = texts.select("source", F.explode(F.split("text", r"(?m)^(?=SF:|end_of_record)")).alias("piece"))
    sf = F.when(F.col("piece").startswith("SF:"), F.regexp_extract("piece", r"\ASF:([^\r\n]*)", 1))
    folder = F.regexp_replace("source", "/[^/]*$", "") if base is None else base
    pieces = pieces.select("source", "piece", sf.alias("sf")).select("source", "piece", F.when(F.col("sf").isNotNull(), _resolved(F.col("sf"), folder)).alias("path"))
    rows = pieces.select("source", "path", F.explode(F.split("piece", "\r?\n")).alias("raw"))
    rows = rows.select("source", "path", "raw", F.regexp_extract("raw", "^([A-Z]+):", 1).alias("tag"), F.regexp_extract("raw", r"(?s)^[A-Z]+:(.*?)\r?$", 1).alias("v"))
    rows = rows.where(F.col("tag").isin("DA", "BRDA", "FN", "FNDA", "FNA"))
    lost = F.raise_error(F.concat(F.col("source"), F.lit(": a record outside SF: "), F.col("raw")))
    rows = rows.select("raw", "tag", F.split("v", ",").alias("f"), "v", F.coalesce(F.col("path"), lost).alias("path"))
    f = lambda i: F.get(F.col("f"), F.lit(i))
    raw, line = F.col("raw"), F.when(F.col("tag").isin("DA", "BRDA"), _number(f(0), 1, F.col("raw")))
    short = F.raise_error(F.concat(F.lit("too few fields: "), raw))
    tail = lambda n: F.regexp_extract("v", "^(?:[^,]*,){%d}(.*)$" % n, 1)
    named = F.when(F.col("tag") == "FN", F.regexp_replace(tail(1), "^[0-9]+,", "")).when(F.col("tag") == "FNDA", tail(1)).when(F.col("tag") == "FNA", tail(2))
    ident = F.when(F.col("tag") == "BRDA", F.when(F.size("f") < 4, short).otherwise(F.concat_ws(",", f(1), f(2)))).otherwise(named)
    count = F.when(F.col("tag") == "DA", F.when(F.size("f") < 2, short).otherwise(f(1))).when(F.col("tag") == "BRDA", F.when(f(3) == "-", "0").otherwise(f(3))).when(F.col("tag") == "FN", "0").when(F.col("tag") == "FNDA", f(0)).otherwise(f(1))
    hits = F.when(count.rlike("^[0-9]+$"), count.cast(HITS)).otherwise(F.raise_error(F.concat(F.lit("not a number that fits: "), raw)).cast(HITS))
    entity = F.when(F.col("tag") == "DA", "line").when(F.col("tag") == "BRDA", "branch").otherwise("function")
    return rows.select("path", entity.alias("entity"), line.alias("line"), ident.alias("id"), hits.alias("hits"))


def _wanted(x: Column | str, what: str) -> Column:
    """x, which the format requires."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull(), F.raise_error(F.concat(F.col("source"), F.lit(f": not valid coverage JSON, {what} is missing")))).otherwise(x)


def gcov(texts: DataFrame) -> DataFrame:
    """One document in a file, or one on each line; what isn't such a document is an error."""
    whole = F.from_json("text", GCOV)["files"].isNotNull() & ~F.col("text").rlike(r"\}\s*\n\s*\{")
    docs = texts.select("source", F.explode(F.when(whole, F.array("text")).otherwise(F.split("text", "\n"))).alias("j")).where("trim(j) not in ('', '\r')")
    d = docs.select("source", F.from_json("j", GCOV).alias("d")).select("source", F.coalesce("d.current_working_directory", F.lit("/")).alias("cwd"), F.explode(_wanted("d.files", "files")).alias("f"))
    d = d.select("source", _resolved(_wanted("f.file", "file"), F.col("cwd")).alias("path"), "f")
    fn = d.select("source", "path", F.explode(_wanted("f.functions", "functions")).alias("x"))
    fn = fn.select("path", F.lit("function").alias("entity"), F.lit(None).cast("bigint").alias("line"), _wanted(F.coalesce("x.demangled_name", "x.name"), "name").alias("id"), _wanted("x.execution_count", "execution_count").alias("hits"))
    number = F.when(F.col("x.line_number") < 1, F.raise_error(F.concat(F.col("source"), F.lit(": line number out of range")))).otherwise(_wanted("x.line_number", "line_number"))
    ln = d.select("source", "path", F.explode(_wanted("f.lines", "lines")).alias("x")).withColumn("line", number)
    own = ln.select("path", F.lit("line").alias("entity"), "line", F.lit(None).cast("string").alias("id"), _wanted("x.count", "count").alias("hits"))
    br = ln.select("source", "path", "line", F.posexplode("x.branches").alias("pos", "b"))
    br = br.select("path", F.lit("branch").alias("entity"), "line", branch_id(F.col("b.source_block_id"), F.col("b.destination_block_id"), F.col("pos")).alias("id"), _wanted("b.count", "count").alias("hits"))
    return own.unionByName(br).unionByName(fn)


def llvm(texts: DataFrame) -> DataFrame:
    """path and the tool's own totals; a path twice is left to the conflict check."""
    f = texts.select("source", F.explode(_wanted(F.from_json("text", LLVM)["data"], "data")).alias("d")).select("source", F.explode(_wanted("d.files", "files")).alias("f"))
    pairs = [_wanted(f"f.summary.{k}.{c}", f"{k}.{c}").alias(n) for k, c, n in zip(("lines", "lines", "branches", "branches", "functions", "functions"), ("count", "covered") * 3, COLUMNS, strict=True)]
    return f.select(normal(_wanted("f.filename", "filename")).alias("path"), *pairs)


def read_coverage(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The long table of the first two forms, and the totals of the third, of whole texts. One without any record is an error."""
    t = texts.withColumn("form", sniff(F.col("text")))
    lost = F.raise_error(F.concat(F.col("source"), F.lit(": no coverage records"))).cast("string")
    lines = t.where("form = 'lcov'").withColumn("text", F.when(F.col("text").contains("SF:"), F.col("text")).otherwise(lost))
    return lcov(lines).unionByName(gcov(t.where("form = 'gcov'"))), llvm(t.where("form = 'llvm'"))
