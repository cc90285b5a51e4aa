"""Sinks: CSV tables, the JSON document and the Markdown report of a project.

Tables are written by one ordered stream from the engine (`toLocalIterator`), so the driver never holds a whole one.
"""

from __future__ import annotations

import csv
import json
import os

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.measures import csv_field, percent_text
from ..functions.paths import component_order
from ..operators import topk
from ..operators.coverage import COLUMNS
from ..operators.summary import ROW
from .engine import Project

SCHEMA, VERSION = "plumbline-report", 1
#: Modules up to which the report shows the whole matrix of coupling.
MATRIX = 12
TABLES = {
    "files": ("file", "module", "role", "parsed", "physical", "blank", "comment", "code"),
    "functions": ("file", "line", "column", "kind", "name", "module", "complexity", "rating", "distinct_operators", "distinct_operands", "total_operators", "total_operands", "volume", "difficulty", "effort"),
    "function_summary": ("module", "functions", "mean", "median", "p90", "max", "flagged", "high", "volume", "effort"),
    "api": ("file", "line", "column", "kind", "name", "module", "documented", "style"),
    "api_summary": ("module", "entities", "documented", "percent", "doxygen"),
    "coverage": ("file", "module", *COLUMNS),
    "modules": tuple(ROW),
}
DIGITS = {"volume": 2, "difficulty": 2, "effort": 2, "mean": 2, "median": 1, "percent": 1, "complexity_mean": 2, "complexity_median": 1, "halstead_volume": 2, "halstead_effort": 2, "documented_percent": 1}


def text(name: str, value) -> str:
    """A value as CSV shows it; decimals are rounded from their exact binary value."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:.{DIGITS.get(name, 2)}f}" if isinstance(value, float) else str(value)


def text_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these columns as CSV shows them, the same as `text` by column expressions."""

    def shown(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        x = F.col(c)
        if kind == "boolean":
            x = F.when(x, "yes").otherwise("no")
        elif kind in ("double", "float"):
            x = F.expr(f"format_number(`{c}`, '0.{'0' * DIGITS.get(c, 2)}')")
        return F.when(F.col(c).isNull(), "").otherwise(x.cast("string"))

    return df.withColumns({c: shown(c) for c in names})


def csv_lines(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """`keep` and `line`: the lines of a table, without their ends."""
    texts = text_columns(df.select(*[F.col(c).alias(f"_key_{c}") for c in keep], *columns), columns)
    return texts.select(*[F.col(f"_key_{c}").alias(c) for c in keep], F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"))


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | list[str]) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
        out.writerow(columns)
        for r in df.select(*columns).toLocalIterator():
            out.writerow([text(c, v) for c, v in zip(columns, r, strict=True)])


def tables(p: Project) -> dict[str, DataFrame]:
    """All tables in their order."""
    by = lambda df: df.orderBy(component_order(F.col("file")), "line", "column")
    whole = lambda df: df.orderBy("is_total", "module")
    lines = p.lines().withColumn("role", F.when(F.col("is_test"), "test").otherwise("production"))
    out = {
        "files": lines.orderBy(component_order(F.col("file"))), "functions": by(p.functions()), "function_summary": whole(p.function_summary().withColumnRenamed("count", "functions")), "api": by(p.api()),
        "api_summary": whole(p.api_summary()), "modules": whole(p.module_rows()), **{f"include_{k}": v for k, v in p.include_graph().items()},
    }
    if p.covered:
        out["coverage"] = p.coverage().orderBy(component_order(F.col("file")))
    return out


def _module(r: dict) -> dict:
    """A module's object: its figures by measure."""
    lines = lambda role: {c: r.get(f"{role}_{c}") for c in ("physical", "blank", "comment", "code")}
    covered = r["coverage_lines"] is not None
    return {
        "module": r["module"], "files": r["files"], "files_parsed": r["files_parsed"], "lines": {"production": lines("production"), "test": lines("test")},
        "complexity": {"functions": r["functions"], **{c: r[f"complexity_{c}"] for c in ("mean", "median", "p90", "max")}, "flagged": r["flagged"], "high": r["high"]},
        "halstead": {"volume": r["halstead_volume"], "effort": r["halstead_effort"]},
        "documentation": {"declarations": r["api"], "documented": r["documented"], "doxygen": r["doxygen"], "percent": r["documented_percent"]},
        "coverage": {c: r[f"coverage_{c}"] for c in COLUMNS} if covered else None,
        "includes": None if r["is_total"] else {c: r[c] for c in ("fan_in", "fan_out", "cycle")},
    }


def document(p: Project, t: dict[str, DataFrame]) -> dict:
    """The JSON document's members. Rows by file come as iterators, so that the driver never holds a whole table."""
    rows = lambda name, make, cols="*": (make(r.asDict()) for r in t[name].select(cols).toLocalIterator())
    role = lambda r: "test" if r["is_test"] else "production"
    modules = [r.asDict() for r in p.module_rows(full=True).orderBy("is_total", "module").collect()]
    cycle = lambda level: (r["members"].split(";") for r in t["include_cycles"].where(F.col("level") == level).toLocalIterator())
    n, pick = p.totals().first(), lambda r, *cols: {c: r[c] for c in cols}
    halstead = ("distinct_operators", "distinct_operands", "total_operators", "total_operands", "volume", "difficulty", "effort")
    return {
        "schema": SCHEMA, "schema_version": VERSION, "tool": {"name": "plumbline", "version": __version__},
        "input": {"root": p.o.root, "compilation_database": p.o.database, "coverage": list(p.o.coverage), "translation_units": n["units"], "units_with_errors": n["units_with_errors"], "units_skipped": n["skipped"], "units_in_build_directory": n["in_build"]},
        "settings": {"complexity": {"flagged_over": p.o.flagged, "high_over": p.o.high}, "test_globs": list(p.o.tests), "modules": [{"module": m, "glob": g} for m, g in p.o.modules]},
        "totals": _module(modules[-1]), "modules": [_module(m) for m in modules[:-1]],
        "files": rows("files", lambda r: {"path": r["file"], "module": r["module"], "role": r["role"], "parsed": r["parsed"], "lines": pick(r, "physical", "blank", "comment", "code")}),
        "functions": rows("functions", lambda r: {**pick(r, "file", "line", "column", "kind", "name", "module"), "role": role(r), **pick(r, "complexity", "rating"), "halstead": pick(r, *halstead)}),
        "api": rows("api", lambda r: {**pick(r, "file", "line", "column", "kind", "name", "module"), "role": role(r), "documentation": r["style"]}),
        "coverage": rows("coverage", lambda r: {"file": r["file"], "module": r["module"], "counts": pick(r, *COLUMNS)}) if "coverage" in t else None,
        "includes": {
            "edges": rows("include_edges", lambda r: pick(r, "from", "to")), "file_cycles": cycle("file"), "module_cycles": cycle("module"),
            "coupling": rows("include_coupling", lambda r: {"from": r["from_module"], "to": r["to_module"], "edges": r["edges"]}),
        },
    }


def json_chunks(value, indent: str = "") -> Iterator[str]:
    """The document's text in pieces, two spaces a level; an iterator is an array."""
    inner = indent + "  "
    if isinstance(value, dict) and value:
        for n, (k, v) in enumerate(value.items()):
            yield ("{" if n == 0 else ",") + f"\n{inner}{json.dumps(k)}: "
            yield from json_chunks(v, inner)
        yield f"\n{indent}}}"
    elif isinstance(value, list | Iterator):
        n = -1
        for n, v in enumerate(value):
            yield ("[" if n == 0 else ",") + f"\n{inner}"
            yield from json_chunks(v, inner)
        yield "[]" if n < 0 else f"\n{indent}]"
    else:
        yield json.dumps(value, ensure_ascii=False)


def json_text(value) -> str:
    return "".join(json_chunks(value)) + "\n"


def _table(head: tuple[str, ...], rows: list) -> list[str]:
    cell = lambda c, v: text(c, v).replace("|", "\\|")
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(cell(c, v) for c, v in zip(head, r, strict=True)) + " |" for r in rows], ""]


def markdown(p: Project, t: dict[str, DataFrame]) -> str:
    """Eight sections, each of small top lists."""
    pick = lambda name, cols, df=None: [tuple(r) for r in (t[name] if df is None else df).select(*cols).collect()]
    total = t["modules"].where("is_total").first()
    out = ["# Code metrics", "", f"Root: `{p.o.root}`", "", "## Summary", ""]
    out += [f"- files: {total['files']} ({total['files_parsed']} parsed)", f"- production code lines: {total['production_code']}; test code lines: {total['test_code']}", f"- functions: {total['functions']}, {total['flagged']} flagged, {total['high']} high"]
    out += [f"- documented: {percent_text(total['documented'], total['api'])} of {total['api']}", ""]
    cols = ("module", "files", "production_code", "test_code", "functions", "flagged", "high", "api", "documented_percent")
    out += ["## Lines", "", *_table(cols, pick("modules", cols))]
    product = p.functions().where("not is_test")
    order = (component_order(F.col("file")), "line", "column")
    for title, measure, k in (("Complexity", "complexity", topk.COMPLEXITY), ("Halstead", "effort", topk.EFFORT)):
        n = topk.shown(product, k).first()
        cols = ("name", "file", "line", measure)
        out += [f"## {title}", "", f"{n['shown']} of {n['all']} functions.", "", *_table(cols, pick("", cols, topk.top(product, k, measure, *order)))]
    bare = p.api().where("not is_test and not documented")
    n = topk.shown(bare, topk.UNDOCUMENTED).first()
    cols = ("name", "kind", "file", "line")
    out += ["## Documentation", "", f"{n['shown']} of {n['all']} undocumented declarations.", "", *_table(cols, pick("", cols, bare.orderBy(*order).limit(topk.UNDOCUMENTED)))]
    out += ["## Coverage", ""]
    if "coverage" in t:
        out += [f"- {k}: {percent_text(total[f'coverage_{k}_covered'], total[f'coverage_{k}'])}" for k in ("lines", "branches", "functions")] + [f"- records outside the root: {p.outside()}", ""]
    else:
        out += ["No coverage data.", ""]
    return "\n".join(out + _includes(t))


def _code(x: str) -> str:
    return f"`{x}`"


def _includes(t: dict[str, DataFrame]) -> list[str]:
    """Counts, every cycle, the files of most edges, and the coupling of modules: whole if it is small, else its heaviest cells."""
    files, edges = t["include_files"].count(), t["include_edges"].count()
    out = ["## Includes", "", f"{files} files, {edges} include edges between them.", ""]
    for level in ("file", "module"):
        rings = t["include_cycles"].where(F.col("level") == level).orderBy("cycle").collect()
        out += [f"{len(rings)} {level} cycle{'s' * (len(rings) > 1)}:" if rings else f"No {level} cycles.", ""]
        out += [f"{r['cycle']}. " + ", ".join(_code(m) for m in r["members"].split(";")) for r in rings] + [""] * bool(rings)
    for title, fan in (("### Most included files", "fan_in"), ("### Files that include the most", "fan_out")):
        rows = topk.top(t["include_files"], topk.FAN, fan, component_order(F.col("file"))).select("file", fan).collect()
        out += [title, "", *_table(("file", fan), [(_code(r[0]), r[1]) for r in rows])]
    out += ["### Module coupling", ""]
    names = [r["module"] for r in t["include_modules"].select("module").orderBy("module").limit(MATRIX + 1).collect()]
    if len(names) <= MATRIX:
        cells = {(r["from_module"], r["to_module"]): r["edges"] for r in t["include_coupling"].collect()}
        out += ["Include edges from each module (rows) to each module (columns):", "", "| |" + "".join(f" {_code(n)} |" for n in names), "|---|" + "---:|" * len(names)]
        out += [f"| {_code(a)} |" + "".join(f" {cells.get((a, b), 0)} |" for b in names) for a in names]
        return [*out, ""]
    cols = ("from_module", "to_module", "edges")
    n = topk.shown(t["include_coupling"], topk.CELLS).first()
    rows = [tuple(r) for r in topk.top(t["include_coupling"], topk.CELLS, "edges", "from_module", "to_module").select(*cols).collect()]
    return out + [f"The {n['shown']} heaviest of {n['all']} counts.", "", *_table(cols, rows)]


def write_report(p: Project, folder: str) -> list[str]:
    """All tables, report.json, report.md and includes.dot; coverage.csv goes if there is no coverage now."""
    os.makedirs(folder, exist_ok=True)
    t = tables(p)
    for name, df in t.items():
        write_csv(df, f"{folder}/{name}.csv", TABLES.get(name) or tuple(df.columns))
    if "coverage" not in t and os.path.exists(f"{folder}/coverage.csv"):
        os.remove(f"{folder}/coverage.csv")
    with open(f"{folder}/report.json", "w", encoding="utf-8") as f:
        f.writelines(json_chunks(document(p, t)))
        f.write("\n")
    for name, body in (("report.md", markdown(p, t)), ("includes.dot", p.dot())):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(body)
    return sorted(os.listdir(folder))
