"""Sources: files of a tree, compilation databases, module maps, path mappings."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import SOURCE_EXTENSIONS, UNASSIGNED, component_order, glob_to_regex, normal

COMMAND = "array<struct<directory string, file string, command string, arguments array<string>>>"


def _is_source_name(name: str) -> bool:
    return "." in name[1:] and name.rsplit(".", 1)[-1].lower() in SOURCE_EXTENSIONS


def _walked(root: str, descend: Callable[[str], bool]) -> Iterator[str]:
    from pyarrow import fs

    remote = "://" in root
    store, at = fs.FileSystem.from_uri(root) if remote else (fs.LocalFileSystem(), root)
    prefix = root[: len(root) - len(at)] if remote and root.endswith(at) else ""
    todo = [at]
    while todo:
        for x in store.get_file_info(fs.FileSelector(todo.pop())):
            if x.type == fs.FileType.Directory and descend(prefix + x.path):
                todo.append(x.path)
            elif x.type == fs.FileType.File and _is_source_name(x.base_name):
                yield prefix + x.path


def listed(root: str, descend: Callable[[str], bool] = lambda folder: True) -> list[str]:
    """Source files below root in component order; a folder that descend() rejects isn't entered."""
    return sorted(_walked(root.rstrip("/") or "/", descend), key=lambda p: p.split("/"))


def pruned(root: str, build: str = "", exclude: tuple[str, ...] = ()) -> Callable[[str], bool]:
    """Which folders of a project hold files of it: not the build folder inside root, nor one that a glob takes whole."""
    root, build = root.rstrip("/"), build.rstrip("/")
    whole = [re.compile(glob_to_regex(g[:-3]).replace(r"\z", r"\Z")) for g in exclude if g.endswith("/**")]

    def descend(folder: str) -> bool:
        return not (build.startswith(root + "/") and folder == build) and not any(w.match(folder[len(root) + 1 :]) for w in whole)

    return descend


def _literal(path: str) -> str:
    """A path in which no character is taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def source_files(spark: SparkSession, *inputs: str, descend: Callable[[str], bool] = lambda folder: True) -> DataFrame:
    """path, content. A file is taken whatever its extension, a folder by extensions, recursively; a missing path is an error.

    Names alone are listed, pruned and compared; each file is then read once, and no content crosses a shuffle.
    """
    names: set[str] = set()
    for p in inputs:
        if "://" not in p and not os.path.exists(p):
            raise FileNotFoundError(f"{p} doesn't exist")
        names |= set(listed(p, descend)) if _is_folder(p) else {p}
    if not names:
        return spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").load([_literal(n) for n in sorted(names)])
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")


def _is_folder(p: str) -> bool:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
    return store.get_file_info(at).type == fs.FileType.Directory


def in_order(df: DataFrame, path: str = "file") -> DataFrame:
    return df.orderBy(component_order(F.col(path)))


def commands(texts: DataFrame) -> DataFrame:
    """The entries of databases (column text): unit_ord, file, directory, command, arguments; files absolute and normal."""
    entries = F.from_json("text", COMMAND)
    keep = [c for c in texts.columns if c != "text"]
    rows = texts.select(*keep, F.posexplode(F.when(entries.isNull(), F.raise_error(F.lit("not a compilation database"))).otherwise(entries)).alias("unit_ord", "c"))
    rows = rows.select(*keep, F.col("unit_ord").cast("bigint").alias("unit_ord"), "c.*")
    return rows.withColumn("file", normal(F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat("directory", F.lit("/"), "file"))))


def compilation_database(spark: SparkSession, path: str) -> DataFrame:
    """A database's entries in its order; without entries it is an error."""
    rows = commands(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))
    if rows.isEmpty():
        raise ValueError(f"{path} holds no compile commands")
    return rows


def module_rules(text: str, name: str = "modules") -> list[tuple[str, str]]:
    """`MODULE = GLOB` a line, # comments; first match wins."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip(" \t\r")
        if not line or line.startswith("#"):
            continue
        module, eq, glob = (x.strip(" \t\r") for x in line.partition("="))
        if not (eq and module and glob):
            raise ValueError(f"{name}:{n}: expected MODULE = GLOB")
        if module == UNASSIGNED:
            raise ValueError(f"{name}:{n}: {UNASSIGNED} is reserved")
        out.append((module, glob))
    return out


def path_mapping(text: str) -> tuple[str, str]:
    old, eq, new = text.partition("=")
    if not (eq and old and new):
        raise ValueError(f"a path mapping is FROM=TO, not {text!r}")
    return old, new
