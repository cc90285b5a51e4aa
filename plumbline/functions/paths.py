"""Paths and globs as column expressions, and the naming of facts by module and role."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNASSIGNED = "(unassigned)"
# The extensions of source files and of headers, and the globs of test code.
SOURCE_EXTENSIONS = ("c", "h", "cc", "cp", "cpp", "cxx", "c++", "hh", "hpp", "hxx", "h++", "inl", "ipp", "tpp", "cppm")
HEADER_EXTENSIONS = ("h", "hh", "hpp", "hxx", "h++", "inl", "ipp", "tpp", "tcc")
TEST_GLOBS = ("**/test/**", "**/tests/**", "**/*_test.*", "**/test_*.*")


def glob_to_regex(glob: str) -> str:
    """`**/` any directories or none, `**` any run, `*` a run without `/`, `?` one character but `/`; whole path."""
    out = []
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", part))
    return r"\A(?s:" + "".join(out) + r")\z"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_to_regex(glob))


def module_of(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The module of the first (module, glob) that matches."""
    out = F.lit(UNASSIGNED)
    for module, glob in reversed(rules):
        out = F.when(glob_match(path, glob), module).otherwise(out)
    return out


def is_test(path: Column, globs=TEST_GLOBS) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | glob_match(path, g)
    return out


def role_of(path: Column, globs=TEST_GLOBS) -> Column:
    return F.when(is_test(path, globs), "test").otherwise("production")


def is_within(path: Column, folder: str) -> Column:
    """Whole components: /a/bc isn't within /a/b."""
    folder = folder.rstrip("/") or "/"
    return (path == folder) | path.startswith(folder if folder == "/" else folder + "/")


def in_project(path: Column, root: str, build: str | None = None, exclude: tuple[str, ...] = ()) -> Column:
    """Under root, not under a build folder strictly inside root, and matching no exclusion (relative to root)."""
    root, build = root.rstrip("/"), (build or "").rstrip("/")
    out = is_within(path, root)
    if build.startswith(root + "/"):
        out = out & ~is_within(path, build)
    for g in exclude:
        out = out & ~glob_match(relative(path, root), g)
    return out


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS)


def is_header(path: Column) -> Column:
    return extension(path).isin(*HEADER_EXTENSIONS)


def normal(path: Column) -> Column:
    """Lexically normal: no empty or `.` components, `..` taken up where a component stands before it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    # element_at(-1) of an empty array is an error: the fold starts with a place holder that no path can hold
    start = F.array(F.lit("\u0000"))
    folded = F.aggregate(parts, start, lambda a, p: F.when(
        (p == "..") & (F.size(a) > 1) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)
    ).when((p == "..") & (F.size(a) == 1) & path.startswith("/"), a).otherwise(F.concat(a, F.array(p))))
    tail = F.array_join(F.slice(folded, F.lit(2), F.size(folded)), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail)


def remap(path: Column, maps: list[tuple[str, str]]) -> Column:
    """The first (from, to) whose from holds the path by whole components re-roots the rest."""
    out = path
    for old, new in reversed(maps):
        old, new = old.rstrip("/"), new.rstrip("/")
        out = F.when(is_within(path, old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(out)
    return out


def component_order(path: Column) -> Column:
    """Orders paths by components (a/b before a-b); plain order of the string is by bytes."""
    return F.split(path, "/")
