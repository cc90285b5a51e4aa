"""Translation units as a table: a row for each compile command comes in, a row of facts for each unit goes out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import paths
from .cfront.command import command, flags, language, predefined
from .cfront.unit import facts

_TOKEN = "array<struct<kind string, spelling string, construct string>>"
_AT = "file string, line int, column int, kind string, name string, seq int"
FACTS = (
    f"unit_ord bigint, file string, functions array<struct<{_AT}, tokens {_TOKEN}>>,"
    f" api array<struct<{_AT}, scope string, at bigint, begin bigint, comment string, comment_end bigint, trailing boolean>>, marks array<struct<file string, name_at array<bigint>>>,"
    " includes array<struct<src string, dst string>>, errors array<string>"
)
#: Tokens, declarations and names that a batch of units' facts may hold before it is handed on.
BATCH_FACTS = 20_000


def accepting(root: str, build: str = "", exclude: tuple[str, ...] = ()) -> Callable[[str], bool]:
    """`paths.in_project` for one path."""
    root, build = root.rstrip("/"), build.rstrip("/")
    shut = [re.compile(paths.glob_to_regex(g).replace(r"\z", r"\Z")) for g in exclude]

    def accept(p: str) -> bool:
        if p != root and not p.startswith(root + "/"):
            return False
        if build.startswith(root + "/") and (p == build or p.startswith(build + "/")):
            return False
        return not any(s.match(p[len(root) + 1 :]) for s in shut)

    return accept


def stored(p: str) -> bytes | None:
    """A file's bytes from any file system that pyarrow knows; None if there is none."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at, compression=None) as f:
        return f.read()


def parse(units: DataFrame, root: str, build: str = "", exclude: tuple[str, ...] = (), resource: str = "") -> DataFrame:
    """units: unit_ord, file, directory, command, arguments, and where sources don't stand in a file system a map `files`
    of path and text. One row of FACTS for each, parsed by itself."""
    schema = to_arrow_schema(T._parse_datatype_string(FACTS))
    columns = ["unit_ord", "file", "directory", "command", "arguments", *(["files"] if "files" in units.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = accepting(root, build, exclude)
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in columns}
                given = dict(r["files"]) if r.get("files") is not None else None
                read = stored if given is None else (lambda p, given=given: given[p].encode() if p in given else None)
                found = facts(r["file"], r["directory"], command(r), read, accept, resource)
                rows.append({"unit_ord": r["unit_ord"], "file": r["file"], **found})
                held += 1 + len(found["api"]) + len(found["includes"]) + sum(len(f["tokens"]) for f in found["functions"]) + sum(len(m["name_at"]) for m in found["marks"])
                if held >= BATCH_FACTS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    # a unit is a row: many small tasks, as one unit may be far longer than the others
    parallel = max(2, 3 * units.sparkSession.sparkContext.defaultParallelism)
    return units.select(*columns).repartition(parallel, "unit_ord").mapInArrow(run, FACTS)


def split_commands(commands: DataFrame) -> DataFrame:
    """Entries with `arguments` in either form: a command line is split as a shell does."""

    @F.pandas_udf("array<string>")
    def split(arguments: pd.Series, line: pd.Series) -> pd.Series:
        return pd.Series([command({"arguments": a, "command": c}) for a, c in zip(arguments, line, strict=True)])

    return commands.withColumn("arguments", F.coalesce("arguments", split("arguments", "command")))


def normalised(commands: DataFrame, key: str, resource: str = "") -> DataFrame:
    """key, language, and what a command sets: search, quote, system, definitions (undefined names without a value), forced."""
    shape = T._parse_datatype_string("language string, search array<string>, quote array<string>, system array<string>, definitions array<string>, forced array<string>")

    @F.pandas_udf(shape)
    def of(arguments: pd.Series, file: pd.Series, directory: pd.Series) -> pd.DataFrame:
        out = []
        for a, f, d in zip(arguments, file, directory, strict=True):
            x, own = flags(list(a), d, f, resource), len(predefined(list(a), f))
            out.append((language(list(a), f), x.search, x.quote, x.system, [n if v is None else f"{n}={v}" for n, v in x.definitions[own:]], x.forced))
        return pd.DataFrame(out, columns=shape.names)

    return split_commands(commands).select(key, of("arguments", "file", "directory").alias("_f")).select(key, "_f.*")
