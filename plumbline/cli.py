"""Commands: loc, functions, coverage, docs, includes, report."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__

OUTPUTS = ("edges", "files", "modules", "cycles", "coupling", "dot")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("--version", action="version", version=f"plumbline {__version__}")
    sub = p.add_subparsers(dest="command")

    def add(name: str, database: bool = True, **kw):
        s = sub.add_parser(name, **kw)
        s.add_argument("--root", default=".")
        s.add_argument("--modules")
        s.add_argument("--exclude", action="append", default=[])
        s.add_argument("--summary", action="store_true")
        if database:
            s.add_argument("-p", "--build-dir", dest="build", required=True, help="the folder of compile_commands.json")
            s.add_argument("--resource-dir", default="", help="the compiler's own headers, in its folder include")
            s.add_argument("--allow-parse-errors", action="store_true")
            s.add_argument("-j", "--jobs", type=int, default=0)
        return s

    loc = sub.add_parser("loc")
    loc.add_argument("paths", nargs="+")
    loc.add_argument("--lines", action="store_true")
    for name in ("functions", "report"):
        s = add(name)
        s.add_argument("--flag-over", type=int, default=10)
        s.add_argument("--high-over", type=int, default=20)
        if name == "report":
            s.add_argument("-o", "--out", dest="output", required=True)
            s.add_argument("--coverage", action="append", nargs="+", default=[])
            s.add_argument("--path-map", action="append", default=[])
            s.add_argument("--test-files", dest="tests", action="append", nargs="+", default=[])
    c = add("coverage", database=False)
    c.add_argument("data", nargs="+")
    c.add_argument("--path-map", action="append", default=[])
    add("docs")
    add("includes").add_argument("--output", type=str.lower, choices=OUTPUTS, default="edges")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command is None:
        return 0
    from pyspark.errors import PySparkException

    try:
        return _run(a, spark or _session(a))
    except (ValueError, OSError, PySparkException, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _session(a):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(f"local[{getattr(a, 'jobs', 0) or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _run(a, spark) -> int:
    from pyspark.sql import functions as F

    from .functions.paths import TEST_GLOBS, component_order
    from .operators import lines
    from .plans import report
    from .plans.engine import Options, Project
    from .sources import files

    def show(df, columns=None) -> None:
        columns = columns or df.columns
        import csv

        out = csv.writer(sys.stdout, lineterminator="\n")
        out.writerow(columns)
        for r in df.select(*columns).toLocalIterator():
            out.writerow([report.text(c, v) for c, v in zip(columns, r, strict=True)])

    if a.command == "loc":
        src = files.source_files(spark, *a.paths)
        if a.lines:
            show(lines.line_table(src).orderBy(component_order(F.col("file")), "line"))
        else:
            counts = lines.line_counts(src)
            show(files.in_order(counts).select("file", "physical", *lines.KINDS))
            print(",".join(str(v) for v in lines.total(counts).first()))
        return 0
    rules = files.module_rules(open(a.modules, encoding="utf-8").read(), a.modules) if a.modules else []
    build = os.path.abspath(a.build) if getattr(a, "build", None) else ""
    flat = lambda x: [z for y in x for z in (y if isinstance(y, list) else [y])]
    data = tuple(os.path.abspath(x) for x in flat(getattr(a, "coverage", None) or getattr(a, "data", ())))
    p = Project(spark, Options(
        os.path.abspath(a.root), build, f"{build}/compile_commands.json" if build else None, rules, tuple(flat(getattr(a, "tests", []))) or TEST_GLOBS, tuple(a.exclude), [files.path_mapping(x) for x in getattr(a, "path_map", [])],
        data, getattr(a, "flag_over", 10), getattr(a, "high_over", 20), getattr(a, "allow_parse_errors", False), os.path.abspath(a.resource_dir) if getattr(a, "resource_dir", "") else "",
    ))
    try:
        return _tables(a, p, show)
    finally:
        p.close()


def _tables(a, p, show) -> int:
    from pyspark.sql import functions as F

    from .functions.paths import component_order
    from .plans import report

    at = (component_order(F.col("file")), "line", "column")
    order = ("is_total", "module")
    if a.command == "functions":
        show(p.function_summary().withColumnRenamed("count", "functions").orderBy(*order), report.TABLES["function_summary"]) if a.summary else show(p.functions().orderBy(*at), report.TABLES["functions"])
        detail = f"{p.functions().count()} functions"
    elif a.command == "docs":
        show(p.api_summary().orderBy(*order), report.TABLES["api_summary"]) if a.summary else show(p.api().orderBy(*at), report.TABLES["api"])
        detail = f"{p.api().count()} declarations"
    elif a.command == "coverage":
        show(p.coverage_summary().orderBy(*order).drop("is_total")) if a.summary else show(p.coverage().orderBy(at[0]), report.TABLES["coverage"])
        sys.stderr.write(f"plumbline: {p.coverage().count()} files, {p.outside()} outside {a.root}\n")
        return 0
    elif a.command == "includes":
        sys.stdout.write(p.dot()) if a.output == "dot" else show(p.include_graph()[a.output])
        detail = f"{p.include_graph()['edges'].count()} include edges"
    else:
        detail = f"wrote {len(report.write_report(p, a.output))} files to {a.output}"
    return p.finish(sys.stderr, detail)


if __name__ == "__main__":
    sys.exit(main())
