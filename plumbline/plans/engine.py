"""A project's facts and tables: one object for each project, one DataFrame for each table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures, paths
from ..operators import api as api_ops
from ..operators import coverage as cov
from ..operators import dedupe, graph, lines, stats, summary, tokens
from ..sources import coverage_files, files, units

#: Errors of a unit that are shown; how many more there are is said.
SHOWN_ERRORS = 5


@dataclass(frozen=True)
class Options:
    root: str
    build: str = ""
    database: str | None = None
    modules: list[tuple[str, str]] = field(default_factory=list)
    tests: tuple[str, ...] = paths.TEST_GLOBS
    exclude: tuple[str, ...] = ()
    path_maps: list[tuple[str, str]] = field(default_factory=list)
    coverage: tuple[str, ...] = ()
    flagged: int = measures.FLAGGED
    high: int = measures.HIGH
    allow_parse_errors: bool = False
    resource: str = ""


def measured(functions: DataFrame) -> DataFrame:
    """Rows with `tokens` measured within their task: complexity and the token counts; the tokens go no further."""
    out = functions.withColumn("complexity", tokens.complexity(F.col("tokens")))
    return tokens.with_halstead(out, "tokens").drop("tokens")


def declarations(facts: DataFrame) -> DataFrame:
    """Each public declaration once, as its first unit declares it, with its documentation's style."""
    # declarations and names leave the facts in one pass: they may be a parse that isn't kept
    columns = facts.schema["api"].dataType.elementType.names
    whole = lambda a: F.struct(F.col("unit_ord"), *[a[c] for c in columns])
    row = lambda file, line, column, at, a: F.struct(file.alias("file"), line.alias("line"), column.alias("column"), at.alias("name_at"), a.alias("declaration"))
    declared = F.transform("api", lambda a: row(a["file"], a["line"], a["column"], F.lit(None).cast("bigint"), whole(a)))
    none = F.lit(None).cast("int")
    no_declaration = F.when(F.lit(False), whole(F.get("api", F.lit(0))))
    named = F.flatten(F.transform("marks", lambda m: F.transform(m["name_at"], lambda at: row(m["file"], none, none, at, no_declaration))))
    rows = facts.select(F.explode(F.concat(declared, named)).alias("r")).select("r.*")
    return api_ops.attach_first(rows, ["file"], ["line", "column"], ["unit_ord", "seq"])


@dataclass(frozen=True)
class Given:
    """A small project that doesn't stand in a file system: files (path, content), database (text), coverage (source, text).

    Every unit gets all files along, so they must fit a task many times over.
    """

    files: DataFrame
    database: DataFrame
    coverage: DataFrame | None = None


class Project:
    def __init__(self, spark: SparkSession, options: Options, given: Given | None = None):
        measures.check_thresholds(options.flagged, options.high)
        self.spark, self.o, self.given = spark, options, given

    @property
    def covered(self) -> bool:
        return bool(self.o.coverage) if self.given is None else self.given.coverage is not None

    def _inside(self, path):
        return paths.in_project(path, self.o.root, self.o.build, self.o.exclude)

    def _named(self, df: DataFrame, path: str = "file") -> DataFrame:
        """file relative to the root, with its module and whether it is test code."""
        name = paths.relative(F.col(path), self.o.root)
        return df.withColumn(path, name).withColumns({"module": paths.module_of(F.col(path), self.o.modules), "is_test": paths.is_test(F.concat(F.lit("/"), F.col(path)), self.o.tests)})

    # Units and facts

    @cached_property
    def plan(self) -> DataFrame:
        """All entries with flags: in_build and skipped (another language)."""
        db = files.compilation_database(self.spark, self.o.database) if self.given is None else files.commands(self.given.database)
        build = self.o.build.rstrip("/")
        inside = paths.is_within(F.col("file"), build) if build.startswith(self.o.root.rstrip("/") + "/") else F.lit(False)
        return db.withColumns({"skipped": ~paths.is_source(F.col("file")), "in_build": inside})

    def totals(self) -> DataFrame:
        p = self.plan.agg(F.expr("count_if(not skipped and not in_build)").alias("units"), F.count_if("skipped").alias("skipped"), F.expr("count_if(in_build and not skipped)").alias("in_build"))
        return p.crossJoin(self.facts.agg(F.count_if(F.size("errors") > 0).alias("units_with_errors")))  # one row each

    @cached_property
    def facts(self) -> DataFrame:
        """One row for each unit; parsed once and kept. Filters stand before the parsing, which Catalyst can't look into."""
        wanted = self.plan.where("not skipped and not in_build").select("unit_ord", "file", "directory", "command", "arguments")
        if self.given is not None:
            whole = self.given.files.agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("files"))
            wanted = wanted.crossJoin(whole)  # one row
        return units.parse(wanted, self.o.root, self.o.build, self.o.exclude, self.o.resource).persist()

    def close(self) -> None:
        """Gives up the kept facts: a later project over changed files must not meet them again."""
        for name in ("facts", "_attributed", "_functions", "_api", "_graph", "_lines"):
            kept = self.__dict__.pop(name, None)
            for df in kept.values() if isinstance(kept, dict) else kept[:1] if isinstance(kept, tuple) else [kept] if kept is not None else []:
                df.unpersist()

    def errors(self) -> DataFrame:
        """file and the first errors of each unit that has some, with how many more there are, in the database's order."""
        return self.facts.where("size(errors) > 0").orderBy("unit_ord").select("file", F.slice("errors", 1, SHOWN_ERRORS).alias("errors"), F.greatest(F.size("errors") - SHOWN_ERRORS, F.lit(0)).alias("more"))

    def finish(self, err, detail: str = "") -> int:
        """Writes all errors and a status line to err; the exit status is 1 if there are errors that aren't allowed."""
        if self.o.database is None and self.given is None:
            return 0
        for r in self.errors().toLocalIterator():
            for e in r["errors"]:
                err.write(f"error: {e}\n")
            if r["more"]:
                err.write(f"  ... and {r['more']} more errors in {r['file']}\n")
        t = self.totals().first()
        out = [f"plumbline: parsed {t['units']} translation units, {t['units_with_errors']} with errors"]
        out += [f"skipped {t['skipped']} entries that are not C or C++"] * (t["skipped"] > 0) + [f"skipped {t['in_build']} units under the build directory"] * (t["in_build"] > 0) + [detail] * bool(detail)
        err.write("; ".join(out) + "\n")
        return int(t["units_with_errors"] > 0 and not self.o.allow_parse_errors)

    # Functions

    def functions(self) -> DataFrame:
        return self._functions

    @cached_property
    def _functions(self) -> DataFrame:
        """One row for each location, as its first unit compiles it."""
        f = self.facts.select("unit_ord", F.explode("functions").alias("f")).select("unit_ord", "f.*")
        f = measured(f)
        f = self._named(dedupe.first_wins(f, ["file", "line", "column"], ["unit_ord", "seq"]))
        n1, n2, t1, t2 = (F.col(c) for c in ("distinct_operators", "distinct_operands", "total_operators", "total_operands"))
        return f.withColumns({
            "rating": measures.rating(F.col("complexity"), self.o.flagged, self.o.high), "volume": measures.volume(n1, n2, t1, t2),
            "difficulty": measures.difficulty(n1, n2, t2), "effort": measures.effort(n1, n2, t1, t2),
        }).persist()

    def function_summary(self) -> DataFrame:
        more = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("volume", "effort")]
        return stats.describe_with_total(self.functions(), "module", "complexity", *more, flagged=self.o.flagged, high=self.o.high)

    # Public interface

    def api(self) -> DataFrame:
        return self._api

    @cached_property
    def _api(self) -> DataFrame:
        return self._named(declarations(self.facts)).withColumns({"documented": F.col("style") != "none", "doxygen": F.col("style") == "doxygen"}).persist()

    def api_summary(self) -> DataFrame:
        return api_ops.doc_summary(self.api())

    # Includes

    def include_graph(self) -> dict[str, DataFrame]:
        """edges, files, modules, cycles, coupling."""
        return self._graph

    @cached_property
    def _graph(self) -> dict[str, DataFrame]:
        named = lambda c: paths.relative(F.col(c), self.o.root)
        raw = self.facts.select(F.explode("includes").alias("e")).select(named("e.src").alias("src"), named("e.dst").alias("dst"))
        edges = graph.distinct_edges(raw)
        own = self.facts.select(F.col("file").alias("node")).where(self._inside(F.col("node"))).select(named("node").alias("node")).distinct()
        groups = graph.nodes(edges, own).withColumn("module", paths.module_of(F.col("node"), self.o.modules))
        rings = graph.number_cycles(graph.strong_components(edges))
        grouped = graph.with_groups(edges, groups)
        mod_nodes = groups.select(F.col("module").alias("node")).distinct()
        mod_edges = graph.group_edges(grouped)
        mod_rings = graph.number_cycles(graph.strong_components(mod_edges))
        sizes = groups.groupBy(F.col("module").alias("node")).agg(F.count(F.lit(1)).alias("files"))
        listed = lambda r, level: graph.cycles(r).select(F.lit(level).alias("level"), "cycle", "size", F.array_join("members", ";").alias("members"))
        out = {
            "edges": grouped.toDF("from", "to", "from_module", "to_module").orderBy("from", "to"),
            "files": groups.join(graph.fan(edges, own), "node").join(rings, "node", "left").select(F.col("node").alias("file"), "module", "fan_in", "fan_out", "cycle").orderBy("file"),
            "modules": sizes.join(graph.fan(mod_edges, mod_nodes), "node").join(mod_rings, "node", "left").select(F.col("node").alias("module"), "files", "fan_in", "fan_out", "cycle").orderBy("module"),
            "cycles": listed(rings, "file").unionByName(listed(mod_rings, "module")).orderBy("level", "cycle"),
            "coupling": graph.coupling(grouped).toDF("from_module", "to_module", "edges").orderBy("from_module", "to_module"),
        }
        return {k: v.persist() for k, v in out.items()}

    def dot(self) -> str:
        g = self.include_graph()
        rows = g["files"].collect()  # a drawing: as large as what is drawn
        return graph.dot([(r[0], r[1]) for r in g["edges"].select("from", "to").collect()], {r["file"]: r["module"] for r in rows}, {r["file"]: r["cycle"] for r in rows if r["cycle"]})

    # Lines

    def lines(self) -> DataFrame:
        return self._lines

    @cached_property
    def _lines(self) -> DataFrame:
        descend = files.pruned(self.o.root, self.o.build, self.o.exclude)
        src = files.source_files(self.spark, self.o.root, descend=descend) if self.given is None else self.given.files
        counts = lines.line_counts(src.where(self._inside(F.col("path")))).withColumn("whole", F.col("file"))
        if self.o.database is None and self.given is None:
            return self._named(counts.withColumn("parsed", F.lit(False))).drop("whole").persist()
        seen = self.facts.select("file").union(self.facts.select(F.explode("includes").alias("e")).select("e.dst")).distinct().select(F.col("file").alias("whole"), F.lit(True).alias("parsed"))
        return self._named(counts.join(seen, "whole", "left").fillna(False, ["parsed"])).drop("whole").persist()

    # Coverage

    @cached_property
    def _attributed(self) -> tuple[DataFrame, DataFrame]:
        hits, totals = coverage_files.read_files(self.spark, *self.o.coverage) if self.given is None else coverage_files.read_coverage(self.given.coverage)
        counts = cov.with_totals(cov.merge(hits), totals)
        path = paths.remap(F.col("path"), self.o.path_maps)
        files_, outside = cov.attribute(counts, path, self._inside(path))
        files_ = files_.persist()
        if files_.isEmpty():
            raise ValueError(f"no covered file is under {self.o.root}")
        return files_, outside

    def coverage(self) -> DataFrame:
        return self._named(self._attributed[0])

    def outside(self) -> int:
        return self._attributed[1].first()["outside"]

    def coverage_summary(self) -> DataFrame:
        return cov.summary(self.coverage())

    # Everything

    def module_rows(self, full: bool = False) -> DataFrame:
        if self.covered:
            self.coverage()  # fails before the expensive scan
        g = self.include_graph()["modules"].drop("files")
        return summary.module_rows(self.lines(), self.functions(), self.api(), self.coverage() if self.covered else None, g, self.o.flagged, self.o.high, full)
