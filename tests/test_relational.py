"""Distributions, naming, deduplication, coverage, graphs and ranges with hand-computed values."""

import json
import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import measures, paths
from plumbline.operators import api
from plumbline.operators import coverage as cov
from plumbline.operators import dedupe, graph, ranges, stats
from plumbline.sources import coverage_files, files


def described(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    return tuple(df.agg(*stats.describe_columns("v", **kw)).first())


def test_describe(spark):
    """Random lists against sorting: the middle, and the smallest value that nine tenths don't exceed."""
    r = random.Random(2)
    for n in (0, 1, 2, 9, 10, 11, 20, 33, 90):
        values = sorted(r.randint(1, 40) for _ in range(n))
        want = (0, 0.0, 0.0, 0, 0, 0, 0)
        if n:
            p90 = next(v for v in values if 10 * sum(x <= v for x in values) >= 9 * n)
            want = (n, sum(values) / n, statistics.median(values), p90, values[-1], sum(v > 10 for v in values), sum(v > 20 for v in values))
        assert described(spark, values) == pytest.approx(want)
    with pytest.raises(ValueError):
        described(spark, [1], flagged=5, high=4)


def test_rating_and_measures(spark):
    df = spark.createDataFrame([(v,) for v in (3, 4, 8, 9)], "v int").select(measures.rating(F.col("v"), 3, 8).alias("r"), measures.rating(F.col("v"), 3, 3).alias("s"))
    assert [r.r for r in df.collect()] == ["ok", "flagged", "flagged", "high"] and [r.s for r in df.collect()] == ["ok", "high", "high", "high"]
    rows = [(6, 10, 20, 31), (9, 2, 14, 2), (0, 0, 0, 0), (1, 0, 4, 0), (3, 0, 8, 0), (0, 2, 0, 5)]
    h = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint")
    a, b, c, d = (F.col(x) for x in "abcd")
    for row, got in zip(rows, h.select(measures.volume(a, b, c, d), measures.difficulty(a, b, d), measures.effort(a, b, c, d)).collect(), strict=True):
        volume = (row[2] + row[3]) * math.log2(row[0] + row[1]) if row[0] + row[1] > 1 else 0.0
        difficulty = row[0] / 2 * row[3] / row[1] if row[1] else 0.0
        assert tuple(got) == pytest.approx((volume, difficulty, volume * difficulty))
    styles = ["/// a", "//// a", "//! a", "/** a */", "/**/", "/*! a */", "// a", "/* a */", None]
    df = spark.createDataFrame([(s,) for s in styles], "c string").select(measures.doc_style(F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == ["doxygen", "plain", "doxygen", "doxygen", "plain", "doxygen", "plain", "plain", "none"]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("src/*.c", ["src/a.c", "src/.c"], ["src/x/a.c", "src/a.cc", "Src/a.c"]), ("**/test/**", ["test/a", "a/test/b/c"], ["tests/a", "atest/b"]), ("a?c", ["abc"], ["a/c", "ac"]),
        ("**", ["", "a/b"], []), ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]), ("x+(y).[z]", ["x+(y).[z]"], ["xx(y)z"]),
    ],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(p,) for p in [*yes, *no]], "p string").select("p", paths.glob_match(F.col("p"), glob).alias("m"))
    assert {r.p for r in df.collect() if r.m} == set(yes)


def test_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(paths.is_within(F.lit("/a/b/c"), "/a/b")) and one(paths.is_within(F.lit("/a/b"), "/a/b/")) and not one(paths.is_within(F.lit("/a/bc"), "/a/b"))
    for raw, want in (("/a/./b/../c//d", "/a/c/d"), ("/../a", "/a"), ("../a/..", ".."), ("a/b/../../c", "c")):
        assert one(paths.normal(F.lit(raw))) == want
    inside = lambda p, **k: one(paths.in_project(F.lit(p), "/r", **k))
    assert inside("/r/a") and not inside("/ra") and not inside("/r/build/a", build="/r/build") and inside("/r/a", build="/r") and inside("/r/a", build="/") and not inside("/r/x/a", exclude=("x/**",))
    rules = files.module_rules("# c\n a = src/** \r\nb=**\n")
    assert rules == [("a", "src/**"), ("b", "**")] and one(paths.module_of(F.lit("src/x"), rules)) == "a" and one(paths.module_of(F.lit("q"), [])) == "(unassigned)"
    for bad in ("nothing", "= x", "a =", "(unassigned) = x"):
        with pytest.raises(ValueError, match="modules:2"):
            files.module_rules(f"\n{bad}\n")
    assert files.path_mapping("/a=/b=c") == ("/a", "/b=c")
    df = spark.createDataFrame([("a-b",), ("a/b",)], "p string")
    assert [r.p for r in df.orderBy(paths.component_order(F.col("p"))).collect()] == ["a/b", "a-b"] and [r.p for r in df.orderBy("p").collect()] == ["a-b", "a/b"]


def test_first_wins(spark):
    r = random.Random(1)
    rows = [(r.choice("pqr"), r.randint(1, 6), r.randint(0, 30), n, r.random()) for n in range(900)]
    df = spark.createDataFrame(rows, "file string, line int, unit int, seq int, value double").repartition(7)
    want = {}
    for row in sorted(rows, key=lambda x: x[2:4]):
        want.setdefault(row[:2], row)
    assert sorted(map(tuple, dedupe.first_wins(df, ["file", "line"], ["unit", "seq"]).collect())) == sorted(want.values())


def counts(texts):
    hits, totals = coverage_files.read_coverage(texts)
    return {r.path: tuple(r)[1:] for r in cov.with_totals(cov.merge(hits), totals).collect()}


def texts(spark, *t):
    return spark.createDataFrame([(f"/t/{i}.info", x) for i, x in enumerate(t)], "source string, text string")


def random_traces(r, files):
    """Tracefiles of random records, and what merging them must give."""
    hit, out = {}, []
    for _ in range(files):
        body = ""
        for _ in range(r.randint(1, 6)):
            name, end = f"m{r.randint(0, 3)}.c", r.choice(["\n", "\r\n"])
            body += f"TN:{end}SF:sub/../{name}{end}"
            for _ in range(r.randint(0, 12)):
                line, n = r.randint(1, 6), r.choice([0, 0, 1, 7, 2**64 - 1])
                kind = r.choice(["DA", "BRDA", "FN", "FNDA", "FNA", "LF", "VER"])
                key = {"DA": ("l", line), "BRDA": ("b", line, n % 3), "FN": ("f", f"g({line}, x)"), "FNDA": ("f", f"g({line}, x)"), "FNA": ("f", f"h{line}")}.get(kind)
                taken = r.choice(["-", str(n)])
                body += {"DA": f"DA:{line},{n}", "BRDA": f"BRDA:{line},0,{n % 3},{taken}", "FN": f"FN:{line},g({line}, x)", "FNDA": f"FNDA:{n},g({line}, x)", "FNA": f"FNA:0,{n},h{line}", "LF": "LF:3", "VER": "VER:x"}[kind] + end
                if key:
                    seen = {"FN": False, "BRDA": taken not in ("-", "0")}.get(kind, n > 0)
                    hit.setdefault(f"/t/{name}", {})
                    hit[f"/t/{name}"][key] = hit[f"/t/{name}"].get(key, False) or seen
            body += f"end_of_record{end}"
        out.append(body)
    return out, {p: tuple(x for k in "lbf" for x in (sum(e[0] == k for e in h), sum(v for e, v in h.items() if e[0] == k))) for p, h in hit.items()}


def test_lcov(spark, tmp_path):
    for seed in range(4):
        body, want = random_traces(random.Random(seed), 3)
        assert counts(texts(spark, *body)) == want
        names = []
        for n, b in enumerate(body):  # the same from files, which are read record by record
            (tmp_path / f"{seed}{n}.info").write_bytes(b.encode())
            names.append(str(tmp_path / f"{seed}{n}.info"))
        hits, _ = coverage_files.read_files(spark, *names)
        assert {r.path.replace(str(tmp_path), "/t"): tuple(r)[1:] for r in cov.merge(hits).collect()} == want
    for bad in ("DA:1,1\nSF:a\n", "SF:a\nDA:x,1\n", "SF:a\nDA:0,1\n", "SF:a\nDA:1\n", "SF:a\nDA:1,-2\n", "SF:a\nBRDA:1,0,0\n", "SF:a\nend_of_record\nDA:1,1\n", "neither form\n", ""):
        with pytest.raises(PySparkException):
            counts(texts(spark, bad))
    (tmp_path / "no.info").write_text("int x;\n")
    with pytest.raises(ValueError, match="no coverage records"):
        coverage_files.read_files(spark, str(tmp_path / "no.info"))


def gcov_text(path, lines, functions=(), cwd="/b"):
    return json.dumps({"format_version": "2", "current_working_directory": cwd, "files": [{"file": path, "functions": list(functions), "lines": [{"line_number": n, "count": c, "branches": b} for n, c, b in lines]}]})


def test_gcov_and_llvm(spark):
    arc = lambda s, d, n: {"count": n, "source_block_id": s, "destination_block_id": d}
    one = gcov_text("in/k.h", [(7, 0, [arc(1, 2, 0), arc(1, 3, 2)]), (8, 1, [{"count": 0}])], [{"name": "_k", "demangled_name": "k(int, int)", "execution_count": 0}])
    two = gcov_text("../k.h", [(7, 0, [arc(1, 2, 1), arc(4, 2, 0)]), (9, 0, [])], [{"name": "_k", "demangled_name": "k(int, int)", "execution_count": 2}, {"name": "c_fn", "execution_count": 0}], "/b/in/x")
    assert counts(texts(spark, one + "\n\n" + two + "\r\n")) == counts(texts(spark, one, two)) == {"/b/in/k.h": (3, 1, 4, 2, 2, 1)}
    pair = lambda a, b: {"count": a, "covered": b}
    llvm = json.dumps({"data": [{"files": [{"filename": "/s/../s/y.c", "summary": {"lines": pair(31, 7), "branches": pair(0, 0), "functions": pair(5, 5)}}]}], "type": "llvm.coverage.json.export"})
    assert counts(texts(spark, llvm)) == {"/s/y.c": (31, 7, 0, 0, 5, 5)}
    zero = gcov_text("a", [(0, 1, [])])
    for bad in ([llvm, llvm], [llvm, "SF:/s/y.c\nDA:1,1\nend_of_record\n"], ['{"other": 1}'], [one[:-9]], ['{"format_version": "2"}'], [zero], ['{"type": "llvm.coverage.json.export"}'], [one.replace('"count"', '"counted"')]):
        with pytest.raises(PySparkException):
            counts(texts(spark, *bad))


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "f"), ("f", "e"), ("x", "a"), ("a", "b")]


def test_graph(spark):
    e = graph.distinct_edges(spark.createDataFrame(EDGES, "src string, dst string"))
    fan = {r.node: (r.fan_in, r.fan_out) for r in graph.fan(e, spark.createDataFrame([("lone",), ("a",)], "node string")).collect()}
    assert fan == {"a": (2, 1), "b": (1, 1), "c": (1, 2), "d": (2, 1), "e": (1, 1), "f": (1, 1), "x": (0, 1), "lone": (0, 0)}
    for bound, small in ((graph.TASK_EDGES, graph.SMALL_EDGES), (graph.TASK_EDGES, 0), (1, 0)):
        rings = graph.number_cycles(graph.strong_components(e, task_edges=bound, small_edges=small))
        assert {r.node: r.cycle for r in rings.collect()} == {"a": 1, "b": 1, "c": 1, "e": 2, "f": 2}
    assert [r.members for r in graph.cycles(rings).orderBy("cycle").collect()] == [["a", "b", "c"], ["e", "f"]]
    groups = spark.createDataFrame([(n, "p" if n in "abc" else "q") for n in "abcdefx"], "node string, module string")
    g = graph.with_groups(e, groups)
    assert {(r.from_group, r.to_group): r.edges for r in graph.coupling(g).collect()} == {("p", "p"): 3, ("p", "q"): 1, ("q", "q"): 3, ("q", "p"): 1}
    assert {(r.src, r.dst) for r in graph.group_edges(g).collect()} == {("p", "q"), ("q", "p")}
    assert graph.strong_components(e.where("src = 'none'")).count() == 0
    assert "color=red" in graph.dot([("a", "b")], {"a": "m", "b": "m"}, {"a": 1, "b": 1})


def test_large_ring(spark):
    n = 200_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    got = graph.strong_components(ring, trim_rounds=0, small_edges=1000).agg(F.count(F.lit(1)), F.max("cycle_min")).first()
    assert tuple(got) == (n, 0)


def brute_cycles(edges):
    """node -> the smallest node of its component, for components of more than one node, by plain reachability."""
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x} - seen
            seen |= new
            todo += new
        reach[n] = seen
    return {n: min(c) for n in reach if len(c := {n} | {x for x in reach[n] if n in reach[x]}) > 1}


def test_cycles_of_whole_tables(spark, tmp_path):
    """Every line of every order counts, whatever stands in it; lines of different orders don't meet."""
    from plumbline.plans import registry

    rng = random.Random(3)
    lines_ = [(o, i, s) for o, suppliers in enumerate(([1, 2, 3, 1], [4, 5, 4], [6, 7, 8], [15, 16, 15], [9, 9], [rng.randint(20, 60) for _ in range(50)])) for i, s in enumerate(suppliers)]
    spark.createDataFrame(rng.sample(lines_, len(lines_)), "l_orderkey bigint, l_linenumber int, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = brute_cycles({(a[2], b[2]) for a, b in zip(lines_, lines_[1:]) if a[0] == b[0]})
    low = sorted(set(want.values()))
    assert {r.node: r.cycle for r in registry.queries()["scc_cycles"](spark, str(tmp_path)).collect()} == {n: low.index(c) + 1 for n, c in want.items()}
    assert {1, 4, 15} <= set(low) and not {6, 9} & set(want)

    turns = [(c, t, rng.choice("abcd")) for c in range(40) for t in range(rng.randint(1, 8))]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute_cycles({(f"{a[0]}:{a[2]}", f"{b[0]}:{b[2]}") for a, b in zip(turns, turns[1:]) if a[0] == b[0]})
    assert {r.node: r.cycle_min for r in registry.queries()["scc_turns"](spark, str(tmp_path)).collect()} == want and len(set(want.values())) > 9


def test_ranges(spark):
    spans = spark.createDataFrame([("f", 1, 10, 20), ("f", 2, 20, 30), ("f", 3, 5, 11), ("g", 4, 10, 20)], "k string, id int, b int, e int")
    marks = spark.createDataFrame([("f", 20), ("f", 10), ("f", 25)], "k string, at int")
    assert {r.id for r in ranges.gap_free(spans, marks, ["k"], "b", "e", "at").collect()} == {1, 4}
    points = spark.createDataFrame([("f", p) for p in (9, 10, 15, 19, 20, 30)], "k string, at int")
    r = spans.select("k", "b", "e")
    got = {x.at: x.covered for x in ranges.in_ranges(points, r, ["k"], "at", "b", "e").collect()}
    assert got == {9: 1, 10: 2, 15: 1, 19: 1, 20: 1, 30: 0}
    strict = {x.at: x.covered for x in ranges.in_ranges(points, r, ["k"], "at", "b", "e", strict=True).collect()}
    assert strict == {9: 1, 10: 1, 15: 1, 19: 1, 20: 0, 30: 0}


def test_overlapping_keeps_every_row(spark):
    r = random.Random(9)
    some = lambda n, least: [(r.choice("fg"), b, b + r.randint(least, 6)) for b in (r.randint(0, 40) for _ in range(n))]
    left, right = some(60, 0), some(12, 0)
    left += left[:25]  # repeated rows
    df = lambda rows: spark.createDataFrame(rows, "k string, b int, e int")
    want = sorted((k, b, e, any(k == k2 and b < e2 and b2 < e for k2, b2, e2 in right if b2 < e2)) for k, b, e in left)
    assert sorted(map(tuple, ranges.overlapping(df(left), df(right), ["k"], "b", "e").collect())) == want


def test_attach_keeps_every_row(spark):
    """Two names of one declaration begin at one place; a repeated row stays two."""
    d = spark.createDataFrame([("f", "a", 10, "/// x", 5, False), ("f", "b", 10, "/// x", 5, False), ("f", "b", 10, "/// x", 5, False), ("f", "c", 30, "// y", 20, False), ("f", "d", 40, None, None, False), ("f", "e", 50, "///< z", 60, True)], "file string, name string, begin int, comment string, comment_end int, trailing boolean")
    marks = spark.createDataFrame([("f", 14), ("f", 17), ("f", 25), ("g", 7)], "file string, name_at int")
    assert sorted((x.name, x.style) for x in api.attach(d, marks, ["file"]).collect()) == [("a", "doxygen"), ("b", "doxygen"), ("b", "doxygen"), ("c", "none"), ("d", "none"), ("e", "doxygen")]


def test_pruned_walk(spark, tmp_path):
    for name in ("a/x.c", "a/[odd]{1}?*.h", "build/y.c", "ven/z.cpp", "a/n.txt", ".c", "B.CPP"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    root = str(tmp_path)
    entered = []
    descend = files.pruned(root, f"{root}/build", ("ven/**",))
    got = files.source_files(spark, root, f"{root}/a/n.txt", f"{root}/a", descend=lambda f: entered.append(f) or descend(f))
    assert sorted((r.path[len(root) + 1 :], bytes(r.content).decode()) for r in got.collect()) == [(n, n) for n in ("B.CPP", "a/[odd]{1}?*.h", "a/n.txt", "a/x.c")]
    assert not any(x.startswith(f"{root}/build/") for x in entered) and "Exchange" not in got._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        files.source_files(spark, f"{root}/none")


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_same_result_for_any_partitioning(spark, sf, parts):
    from plumbline.plans import registry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for name in ("module_rows", "first_wins", "scc_cycles", "coverage_summary"):
            rows = sorted(map(str, registry.queries()[name](spark, sf).collect()))
            test_same_result_for_any_partitioning.seen = seen = getattr(test_same_result_for_any_partitioning, "seen", {})
            assert seen.setdefault(name, rows) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
