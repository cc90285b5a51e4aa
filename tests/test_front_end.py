"""Lines, tokens, functions, declarations and includes of small sources, and a whole project's report."""

import csv
import json
import random
import re

import pytest

from plumbline import cli
from plumbline.plans.engine import declarations
from plumbline.sources import units
from plumbline.sources.cfront import preprocess
from plumbline.sources.cfront.command import flags
from plumbline.sources.cfront.lexer import lex, line_counts, line_kinds
from plumbline.sources.cfront.scanner import Scanner
from plumbline.sources.cfront.unit import facts
from plumbline.sources.units import FACTS

B, C, K = "blank", "comment", "code"


@pytest.mark.parametrize(
    ("source", "kinds"),
    [
        ("", ""), ("\n\n", "bb"), ("//only\n", "c"), ("x\r\n \r\n//\r\n", "kbc"), ("f(/* one\n\ttwo */);", "kk"), ("/* one\n*/\n", "cc"), ("/*/\n*/ y\n", "ck"), ("1'2'3; // a\n/*'*/\n", "kc"), ("id'/*'\nz\n", "kk"),
        ("\"/*\"\n'//'\n", "kk"), ("\"\\\"//\"\n// t\n", "kc"), ("\"never closed\n// t\n", "kc"), ('R"//(\n/*\n)//"\n/**/', "kkkc"), ('uR"(\n\n)" // t\n\n', "kbkb"), ('fR"(\n/*"\n*/\n', "kcc"), ("/\\\r\n/ c\n\\\n", "ccb"),
        ("// goes on \\\nhere\nno\n", "cck"), ("\xef\xbb\xbf\n//\n", "bc"), ("a\rb\n\v\f\t\n", "kb"), ('LR"(\\\n)"', "kk"), ("0b1'0'/*\n*/", "kk"), (".5'6 /*\n*/", "kc"),
    ],
)
def test_line_kinds(source, kinds):
    assert line_kinds(source.encode("latin-1")) == [{"b": B, "c": C, "k": K}[x] for x in kinds]
    assert line_counts(source.encode("latin-1")) == tuple(kinds.count(x) for x in "bck")


def plain_kinds(source):
    """A state for each character, without splices or raw strings: what line_kinds must say of such sources."""
    out, state, line, i = [], "", "b", 0
    while i < len(source):
        two, c = source[i : i + 2], source[i]
        i += 1
        if state == "" and two in ("//", "/*") or state == "/*" and two == "*/":
            line, i = max(line, "c", key="bck".index), i + 1
            state = two if state == "" else ""
        elif c == "\n":
            out.append(line)
            line, state = "b", state if state == "/*" else ""
        elif c not in " \t":
            line = max(line, "c" if state in ("//", "/*") else "k", key="bck".index)
            if state in ('"', "'"):
                i += c == "\\" and two[1:] != "\n"
                state = "" if c == state else state
            elif state == "" and c in "\"'":
                state = c
    return out + [line] * (source[-1:] not in ("", "\n"))


def test_line_kinds_against_states():
    r = random.Random(5)
    for _ in range(4000):
        source = "".join(r.choice(["/", "*", "//", "/*", "*/", '"', "'", "\n", " ", "x", ";", "\\", '"a"']) for _ in range(r.randint(0, 30))).replace("x'", "; '")
        source = re.sub(r"\\+\n", "\n", source)
        assert line_kinds(source.encode()) == [{"b": B, "c": C, "k": K}[x] for x in plain_kinds(source)], source


def scan(source):
    return Scanner([t for t in lex(source.encode()) if t.kind != "comment"]).scan()


def complexity(f):
    return 1 + sum(bool(t["construct"]) for t in f.own)


SOURCE = """
namespace geo {
namespace { int hidden(int a) { return a ? 1 : 2; } }
struct Point {
  Point(int v) : x(v > 0 ? v : 0), y{0} { if (x && y) { x = 1; } }
  ~Point() {}
  Point(const Point &) = default;
  operator int() const { return x; }
  template <typename T> T scaled(T k) const { return k * x; }
  int sum() const { for (auto &&e : {1, 2}) { (void)e; } return x + y; }
  int x, y;
};
int area(size_t w, size_t h);
}
int geo::area(size_t w, size_t h) { do { w--; } while (w); while (h) --h; return 0; }
int outer(int n) {
  auto f = [&n](int k) -> int { return k || n ? 1 : 2; };
  struct Local { int sign(int v) { return v < 0 ? -1 : 1; } };
  switch (n) { case 1: case 2: return 1; default: break; }
  try { n = 1; } catch (int) { n = 2; } catch (...) { n = 3; }
  return f(n);
}
int *pick(int *a, const char *b = "x") { int &&r = 1; Foo &&q = make(); return a ?: nullptr; }
bool operator&&(Flag a, Flag b) { return true; }
template <class... T> bool all_of(T &&...t) { return (t && ...); }
static inline unsigned long long odd(std::vector<std::pair<int, int>> v, void (*cb)(int)) noexcept(false) { if constexpr (true) return 1; return static_cast<T &&>(v), a and b; }
"""


def test_functions():
    found = {f.name: (f.kind, complexity(f)) for f in scan(SOURCE).functions}
    assert found == {
        "geo::(anonymous namespace)::hidden(int)": ("function", 2), "geo::Point::Point(int)": ("constructor", 4), "geo::Point::~Point()": ("destructor", 1), "geo::Point::operator int()": ("conversion", 1),
        "geo::Point::scaled(T)": ("function_template", 1), "geo::Point::sum()": ("method", 2), "geo::area(size_t, size_t)": found["geo::area(size_t, size_t)"], "outer(int)": ("function", 5),
        "outer(int)::(lambda)": ("lambda", 3), "outer(int)::Local::sign(int)": ("method", 2), "pick(int *, const char *)": ("function", 2), "operator&&(Flag, Flag)": ("function", 1), "all_of(T &&...)": found.get("all_of(T &&...)"),
        "odd(std::vector<std::pair<int, int>>, void (*cb)(int))": found.get("odd(std::vector<std::pair<int, int>>, void (*cb)(int))"),
    } or list(found)
    assert found["geo::area(size_t, size_t)"][1] == 3
    assert next(v for k, v in found.items() if k.startswith("all_of"))[1] == 2
    assert next(v for k, v in found.items() if k.startswith("odd"))[1] == 3


def halstead(f):
    from plumbline.functions.measures import VALUE_KEYWORDS

    ops, rands = [], []
    for t in f.own:
        if t["kind"] in ("identifier", "literal") or t["spelling"] in VALUE_KEYWORDS:
            rands.append(t["spelling"])
        elif t["spelling"] not in (")", "]", "}"):
            ops.append(t["spelling"])
    return len(set(ops)), len(ops), len(set(rands)), len(rands)


def test_halstead_counts():
    f = scan("long scale(long by) { long r = by * 3; r -= 3; return r; }").functions[0]
    # long ( { = * ; -= return, with long three times and ; three times; scale by r 3
    assert halstead(f) == (8, 12, 4, 8)


def unit(sources, path="/p/a.c", args=("cc",)):
    return preprocess.run(path, lambda p: sources[p].encode() if p in sources else None, flags(list(args), "/p", path))


def texts(u, p):
    return [[t.text for t in x.tokens] for x in u.passes[p]]


def test_conditions_and_includes():
    s = {
        "/p/a.c": '#include "one.h"\n#include "one.h"\n#include <gone.h>\n#include <deep/two.h>\n#if LEVEL > 0x0F && TWICE(LEVEL) == 64\nkept;\n#elif 1\nlost;\n#endif\n#ifndef ONE\nlost;\n#else\nalso;\n#endif\n#if 0\n#include "unread.h"\n#elifdef ONE\nthird;\n#endif\n',
        "/p/one.h": '#ifndef ONE\n#define ONE\n#define TWICE(x) ((x) + (x))\nin_one;\n#include "../p/one.h"\n#endif\n', "/i/deep/two.h": "#pragma once\nin_two;\n",
    }
    u = unit(s, args=("cc", "-I", "../i", "-DLEVEL=32", "a.c"))
    assert u.includes == {("/p/a.c", "/p/one.h"), ("/p/one.h", "/p/one.h"), ("/p/a.c", "/i/deep/two.h")} and not u.errors
    assert texts(u, "/p/a.c") == [["kept", ";", "also", ";", "third", ";"]] and texts(u, "/p/one.h") == [["in_one", ";"]] and texts(u, "/i/deep/two.h") == [["in_two", ";"]]
    assert unit({"/p/a.c": '#include "gone.h"\n#error stop here\n'}).errors == ["/p/a.c: 'gone.h' file not found", "/p/a.c: #error stop here"]
    assert unit({}).errors == ["/p/a.c: file not found"]


@pytest.mark.parametrize(
    ("condition", "args", "holds"),
    [
        ("__cplusplus >= 202002L", ("c++", "-std=c++20"), True), ("__cplusplus >= 202002L", ("c++", "-std=gnu++17"), False), ("__cplusplus == 201703L", ("c++",), True), ("defined __cplusplus", ("cc", "-x", "c"), False),
        ("__STDC_VERSION__ >= 201112L", ("cc", "-x", "c", "-std=c99"), False), ("defined(__linux__) && __GNUC__", ("c++",), True), ("defined linux", ("c++", "-std=c++17"), False), ("_MSC_VER > 1900 && defined _WIN32", ("cl", "/c"), True),
        ("A == 1 && !defined B", ("c++", "-DA", "-DB", "-UB"), True), ("(5 - 7) / 2 == -1 && -7 % 3 == -1 && (1 ? 2 : 3) == 2", ("c++",), True), ("'A' == 65 && 1'000 == 01750 && true", ("c++",), True), ("NOTHING(1, (2)) || __has_attribute(x)", ("c++",), False),
        ("__has_include(<none>) || !__has_include(\"h.h\")", ("c++",), False), ("defined __has_include", ("c++",), True), ("F(2, 3) == 6 && G == 5", ("c++", "-DF(a, b)=a * b", "-DG=F(1 + 1, 4)"), True), ("SELF", ("c++", "-DSELF=SELF + 0"), False),
    ],
)
def test_condition_values(condition, args, holds):
    u = unit({"/p/a.cpp": f"#if {condition}\nyes\n#else\nno\n#endif\n", "/p/h.h": ""}, "/p/a.cpp", args)
    assert texts(u, "/p/a.cpp") == [["yes" if holds else "no"]]


def test_a_file_has_a_pass_for_each_set_of_macros():
    s = {"/p/a.c": '#define V 1\n#include "x.def"\n#undef V\n#define V 2\n#include "x.def"\n#include "x.def"\n', "/p/x.def": "#if V == 1\nfirst\n#else\nsecond\n#endif\n"}
    assert texts(unit(s), "/p/x.def") == [["first"], ["second"]]


def test_driver_arguments():
    f = flags(["clang-cl", "/I..\\x", "/Iinc", "/DN=4", "/D", "M", "/FIall.h", "/std:c++17"], "/p")
    assert f.search[1] == "/p/inc" and ("N", "4") in f.definitions and ("M", "1") in f.definitions and f.forced == ["all.h"] and dict(f.definitions)["__cplusplus"] == "201703L"
    g = flags(["gcc", "-iprefix", "/pre/", "-iwithprefix", "late", "-isystem", "sys", "-iquoteq", "-I."], "/p", "a.c", "/res")
    assert (g.search, g.quote, g.system, g.plain_c) == (["/p"], ["/p/q"], ["/p/sys", "/pre/late", "/res/include"], True)


def api(header, path="/p/a.hpp", args=("c++",), **more):
    files = {path: header, **more}
    return facts(path, "/p", list(args), lambda p: files[p].encode() if p in files else None, lambda p: True)["api"]


@pytest.mark.parametrize(
    ("header", "names"),
    [
        ("extern int a, *b, c[2];", "a b c"), ("struct Q { int u, v : 2; unsigned : 3; } q, *r;", "Q Q::u Q::v q r"), ("enum Tone { lo, hi } tone;", "Tone tone"), ("const int k = 1; constexpr int c = 2; inline const int shown = 3; extern const int out;", "shown out"),
        ("const char *text; char *const fixed = 0;", "text"), ("void (*call)(int), (*other)(void);", "call other"), ("static int s; static void f(); namespace { int n; }", ""), ("std::map<int, std::pair<int, int>> m, w;", "m w"),
        ("struct Fwd; class W { int i; public: void g(); protected: int p; };", "W W::g()"), ("struct D { D() = default; D(int); ~D(); D &operator=(const D &) = delete; };", "D D::D(int) D::~D()"), ("void once(int); void once(int);", "once(int)"),
        ("typedef struct node { int n; } node_t;", "node_t node_t::n"), ("#define HANDLE(x) typedef struct x##_s *x;\nHANDLE(door)\nHANDLE(window)", "door window"), ("using size = unsigned; template <class T> using vec = T;", "size vec"),
    ],
)
def test_public_declarations(header, names):
    assert sorted(a["name"] for a in api(header)) == sorted(names.split())


def test_constants_have_linkage_in_c():
    assert [a["name"] for a in api("const int limit = 3; static const int own = 1;", "/p/a.h", ("cc", "-x", "c"))] == ["limit"]


def test_comments_of_declarations(spark):
    header = "/// far\n\nint near_one(int);\nint bare; // of bare\nint next_one;\n/* both */\nextern long a, b;\n/** lost */\n#define M\nint after;\n/// group\n/// of lines\nint grouped();\nstruct S { int x; ///< of x\n int y; };\n"
    rows = facts("/p/a.hpp", "/p", ["c++"], lambda p: header.encode() if p == "/p/a.hpp" else None, lambda p: True)
    df = units_table(spark, rows)
    got = {r["name"]: r["style"] for r in declarations(df).collect()}
    assert got == {"near_one(int)": "doxygen", "bare": "plain", "next_one": "none", "a": "plain", "b": "plain", "after": "none", "grouped()": "doxygen", "S": "none", "S::x": "doxygen", "S::y": "none"}


def test_declarations_of_several_units(spark):
    # the second unit's earlier names stand in gaps too; of one place the first unit's declaration counts
    decl = lambda line, kind, seq, begin, comment, end: {"file": "/p/a.h", "line": line, "column": 1, "kind": kind, "name": f"{kind}{line}", "seq": seq, "scope": "", "at": begin, "begin": begin, "comment": comment, "comment_end": end, "trailing": False}
    unit = lambda k, api, names: {"unit_ord": k, "file": f"/p/{k}.c", "functions": [], "api": api, "marks": [{"file": "/p/a.h", "name_at": n} for n in names], "includes": [], "errors": []}
    one = unit(1, [decl(3, "late", 0, 30, "// x", 20), decl(5, "one", 1, 50, "/// y", 40)], [[30, 50], [30]])
    zero = unit(0, [decl(3, "first", 1, 30, "// x", 20), decl(5, "again", 0, 50, None, None)], [[25, 30]])
    df = spark.createDataFrame([one, zero, unit(2, [], []), unit(3, [decl(5, "later", 0, 50, "/// y", 40)], [])], FACTS)
    got = declarations(df)
    assert sorted((r["unit_ord"], r["name"], r["style"]) for r in got.collect()) == [(0, "again5", "none"), (0, "first3", "none")]
    assert got.columns[:3] == ["unit_ord", "file", "line"]


def test_units_are_parsed_once_and_in_batches(spark, monkeypatch):
    monkeypatch.setattr(units, "BATCH_FACTS", 5)
    text = lambda k: f"/// a\nint f{k}(int);\nstruct S{k} {{ int x; }}; // b\n"
    rows = [(k, "/p/a.h", "/p", None if k % 2 else "c++ -DX", ["c++"] if k % 2 else None, {"/p/a.h": text(k)}) for k in range(50)]
    df = spark.createDataFrame(rows, "unit_ord bigint, file string, directory string, command string, arguments array<string>, files map<string, string>")
    parsed = units.parse(df, "/p")
    got = sorted(parsed.collect(), key=lambda r: r["unit_ord"])
    assert [(r["unit_ord"], [a["name"] for a in r["api"]]) for r in got] == [(k, [f"f{k}(int)", f"S{k}", f"S{k}::x"]) for k in range(50)]
    plan = declarations(parsed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1


def test_macros_of_commands_stay_apart():
    source = b"#ifdef A\nint a(){return 0;}\n#undef A\n#define B 1\n#endif\n#ifdef B\nint b(){return 0;}\n#endif\n"
    names = lambda *args: [f["name"] for f in facts("/p/a.c", "/p", ["cc", *args], lambda p: source if p == "/p/a.c" else None, lambda p: True)["functions"]]
    for _ in range(2):
        assert names("-DA") == ["a()", "b()"] and names() == [] and names("-DA", "-UA") == [] and names("-DB=2") == ["b()"]


def units_table(spark, rows):
    return spark.createDataFrame([{"unit_ord": 0, "file": "/p/a.hpp", **rows}], FACTS)


def test_functions_that_macros_make():
    s = "#define MAKE(n, e) static int n(int a) { if (a) return e; return 0; }\nMAKE(one, a || 1)\n#define CASE(a) void a##_case()\n#define WRAP CASE(inner); void outer_case()\nWRAP { for (;;) {} }\nint plain() { MAKE(no, 1) return 0; }\n#define OPEN namespace z {\nOPEN int in_z() { return 1; } }\n"
    f = facts("/p/a.cpp", "/p", ["c++"], lambda p: s.encode() if p == "/p/a.cpp" else None, lambda p: True)["functions"]
    assert [(x["name"], x["line"], 1 + sum(bool(t["construct"]) for t in x["tokens"])) for x in f] == [("one(int)", 2, 2), ("outer_case()", 5, 2), ("plain()", 6, 1), ("in_z()", 8, 1)]


FILES = {
    "src/main.c": '#include "ring/a.h"\n#include "util.h"\nint main(void) { return a_of(1) && util(2) ? 0 : 1; }\n',
    "src/ring/a.h": '#ifndef A_H\n#define A_H\n#include "b.h"\n/// Of a.\nstatic inline int a_of(int v) { return v; }\nint a_decl(int);\n#endif\n',
    "src/ring/b.h": '#ifndef B_H\n#define B_H\n#include "a.h"\n/** Of b. */\nint b_of(int v);\n#endif\n',
    "src/util.h": "#pragma once\nint util(int v);\n",
    "tests/test_main.c": '#include "../src/util.h"\nint test(int v) { if (v) return util(v); return 0; }\n',
    "notes.txt": "int x;\n",
}


@pytest.fixture
def project(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    build = tmp_path / "build"
    build.mkdir()
    entry = lambda f, **k: {"directory": str(build), "file": f"{tmp_path}/{f}", **k}
    db = [entry("src/main.c", arguments=["cc", "-I../src", "-c", "x"]), entry("tests/test_main.c", command="cc -c 'x y.c'"), entry("src/old.f90", arguments=["f"]), entry("build/gen.c", arguments=["cc"])]
    (build / "compile_commands.json").write_text(json.dumps(db))
    (tmp_path / "modules.txt").write_text("ring = src/ring/**\napp = src/**\n")
    (tmp_path / "cov.info").write_text("SF:src/main.c\nDA:3,1\nDA:4,0\nFN:3,main\nFNDA:1,main\nend_of_record\nSF:/else/x.c\nDA:1,1\nend_of_record\n")
    return tmp_path


def table(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def test_report(spark, project):
    args = ["--root", str(project), "-p", str(project / "build"), "--modules", str(project / "modules.txt")]
    out = project / "out"
    assert cli.main(["report", *args, "-o", str(out), "--coverage", str(project / "cov.info"), "--exclude", "out/**"], spark) == 0
    rows = {r["module"]: r for r in table(out / "modules.csv")}
    assert list(rows) == ["(unassigned)", "app", "ring", "TOTAL"]
    assert rows["app"]["functions"] == "1" and rows["app"]["complexity_max"] == "3" and rows["app"]["coverage_lines"] == "2" and rows["app"]["coverage_lines_covered"] == "1"
    assert rows["(unassigned)"]["functions"] == "0" and rows["(unassigned)"]["test_code"] == "2" and rows["TOTAL"]["functions"] == "2" and rows["TOTAL"]["fan_in"] == ""
    assert {r["name"]: r["style"] for r in table(out / "api.csv")} == {"a_decl(int)": "none", "b_of(int)": "doxygen", "util(int)": "none"}
    assert {(r["from"], r["to"]) for r in table(out / "include_edges.csv")} == {("src/main.c", "src/ring/a.h"), ("src/main.c", "src/util.h"), ("src/ring/a.h", "src/ring/b.h"), ("src/ring/b.h", "src/ring/a.h"), ("tests/test_main.c", "src/util.h")}
    assert [(r["level"], r["members"]) for r in table(out / "include_cycles.csv")] == [("file", "src/ring/a.h;src/ring/b.h")]
    assert {r["file"]: r["parsed"] for r in table(out / "files.csv")}["src/util.h"] == "yes" and [r["file"] for r in table(out / "files.csv")][0] == "src/main.c"
    doc = json.loads((out / "report.json").read_text())
    assert doc["input"]["translation_units"] == 2 and doc["input"]["units_skipped"] == 1 and doc["input"]["units_in_build_directory"] == 1 and doc["totals"]["includes"] is None and doc["totals"]["lines"]["test"]["code"] == 2 and doc["includes"]["file_cycles"] == [["src/ring/a.h", "src/ring/b.h"]]
    text = (out / "report.md").read_text()
    assert text.count("\n## ") == 7 and "1. `src/ring/a.h`, `src/ring/b.h`" in text and "| `ring` |" in text and "records outside the root: 1" in text and "subgraph" in (out / "includes.dot").read_text()
    assert cli.main(["report", *args, "-o", str(out), "--exclude", "out/**"], spark) == 0 and not (out / "coverage.csv").exists()


def test_commands(spark, project, capsys):
    args = ["--root", str(project), "-p", str(project / "build")]
    assert cli.main(["loc", str(project / "src"), str(project / "notes.txt")], spark) == 0
    assert "TOTAL,19,0,2,17" in capsys.readouterr().out
    assert cli.main(["functions", *args, "--summary", "--flag-over", "1", "--high-over", "2"], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1].startswith("TOTAL,3,2.00,2.0,3,3,2,1,")
    assert cli.main(["functions", *args, "--flag-over", "5", "--high-over", "2"], spark) == 1
    assert cli.main(["includes", *args, "--output", "CYCLES"], spark) == 0
    assert "file,1,2,src/ring/a.h;src/ring/b.h" in capsys.readouterr().out
    err = "".join(f'#include "gone{n}.h"\n' for n in range(8))
    (project / "src/many.c").write_text(err)
    (project / "src/main.c").write_text('#include "gone.h"\n')
    assert cli.main(["docs", *args], spark) == 1 and "gone.h" in capsys.readouterr().err
    assert cli.main(["docs", *args, "--allow-parse-errors"], spark) == 0
    (project / "far.info").write_text("SF:/else/x.c\nDA:1,1\nend_of_record\n")
    assert cli.main(["coverage", str(project / "far.info"), "--root", str(project)], spark) == 1
