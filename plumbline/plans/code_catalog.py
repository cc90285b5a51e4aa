"""Named queries of the parsing half: sources are written from the tables' rows, so that what they hold is known in SQL.

Each row of `part` is a small unit; the rows of `nation` together are a project of headers, sources and tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures, paths, tables
from ..operators import graph, lines
from ..sources import coverage_files, files, units
from . import report
from .catalog import _sources
from .engine import Given, Options, Project, declarations, measured
from .registry import query
from .registry import table as _t

K = "cast(p_partkey as string)"


def _text(template: str) -> Column:
    """A source of a template in which `{sql}` stands for an expression's text; `{{` and `}}` are braces."""
    out, at = [], 0
    template = template.replace("{{", "\x01").replace("}}", "\x02")
    while (i := template.find("{", at)) >= 0:
        j = template.index("}", i)
        out += [F.lit(template[at:i].replace("\x01", "{").replace("\x02", "}")), F.expr(template[i + 1 : j].replace("\x01", "{").replace("\x02", "}"))]
        at = j + 1
    return F.concat(*out, F.lit(template[at:].replace("\x01", "{").replace("\x02", "}")))


def _units(spark, d, sources: dict[str, Column], main: str, arguments: Column | None = None, directory: str = "/p") -> DataFrame:
    """Facts of one unit for each part."""
    given = F.map_from_arrays(F.array(*[F.lit(k) for k in sources]), F.array(*sources.values()))
    none = F.array(F.lit("c++"))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("unit_ord"), F.lit(main).alias("file"), F.lit(directory).alias("directory"), F.lit(None).cast("string").alias("command"), (none if arguments is None else arguments).alias("arguments"), given.alias("files"))
    return units.parse(rows, "/p")


# Functions

FUNCTIONS = """namespace n{K} {{
namespace {{ int hidden(int a) {{ return a; }} }}
struct S{K} {{
  S{K}(int v) : x(v) {{}}
  ~S{K}() {{}}
  operator int() const {{ return x; }}
  template <typename T> T scaled(T k) const {{ return k; }}
  int twice() const {{ auto f = [](int q) {{ return q + q; }}; return f(x); }}
  int x;
  S{K}(const S{K} &) = default;
}};
int defined(unsigned w);
}}
int n{K}::defined(unsigned w) {{ return 0; }}
extern "C" {{
{repeat('static int extra() {{ return 1; }}\\n', p_size % 3)} }}
"""


@query(
    """WITH p AS (SELECT p_partkey, 'n' || p_partkey AS n, 'n' || p_partkey || '::S' || p_partkey AS s, 'S' || p_partkey AS c, length(p_partkey::varchar) AS k, p_size FROM part),
    f AS (SELECT p_partkey, unnest([
      {'line': 2, 'column': 17, 'kind': 'function', 'name': n || '::(anonymous namespace)::hidden(int)'}, {'line': 4, 'column': 3, 'kind': 'constructor', 'name': s || '::' || c || '(int)'},
      {'line': 5, 'column': 3, 'kind': 'destructor', 'name': s || '::~' || c || '()'}, {'line': 6, 'column': 3, 'kind': 'conversion', 'name': s || '::operator int()'},
      {'line': 7, 'column': 27, 'kind': 'function_template', 'name': s || '::scaled(T)'}, {'line': 8, 'column': 7, 'kind': 'method', 'name': s || '::twice()'},
      {'line': 8, 'column': 32, 'kind': 'lambda', 'name': s || '::twice()::(lambda)'}, {'line': 14, 'column': (8 + k)::int, 'kind': 'function', 'name': n || '::defined(unsigned)'}]) AS f FROM p),
    x AS (SELECT p_partkey, unnest(list_transform(range(0, p_size % 3), lambda i: {'line': 16 + i, 'column': 12, 'kind': 'function', 'name': 'extra()'})) AS f FROM p)
    SELECT p_partkey, f.line::int AS line, f."column"::int AS "column", f.kind AS kind, f.name AS name FROM (SELECT * FROM f UNION ALL SELECT * FROM x)"""
)
def unit_functions(spark, d):
    """Definitions with a body: their kinds, qualified names, lines and columns."""
    f = _units(spark, d, {"/p/a.cpp": _text(FUNCTIONS.replace("{K}", "{%s}" % K))}, "/p/a.cpp").select("unit_ord", F.explode("functions").alias("f"))
    return f.select(F.col("unit_ord").alias("p_partkey"), "f.line", "f.column", "f.kind", "f.name")


DECISIONS = """template <class T, class... U> int f(int a, int b, T &&c, U &&...u) {{
{repeat('  if (a && b) a++;\\n', p_size % 7)}  do {{ a--; }} while (a > 0);
{repeat('  a = b ?: 1;\\n', p_size % 4)}  switch (a) {{ {repeat('case 1: case 2: break; ', p_size % 5)}default: ; }}
  auto l = [&](int k) {{ return k or a and b; }};
  try {{ a = 1; }} catch (int) {{ }} catch (...) {{ }}
#if 0
  if (a) {{}}
#endif
  int &&r = 1; auto &&s = a; for (auto &&e : {{1, 2}}) (void)e;
  while (a) --a;
  return static_cast<T &&>(c), (u && ...);
}}
"""


@query("SELECT p_partkey, unnest([{'name': 'f(int, int, T &&, U &&...)', 'n': 7 + 2 * (p_size % 7) + p_size % 4 + 2 * (p_size % 5)}, {'name': 'f(int, int, T &&, U &&...)::(lambda)', 'n': 3}], recursive := true) FROM part")
def unit_complexity(spark, d):
    """Decisions: do but not its while, `?:`, cases, catches, lambdas by themselves, rvalue references not, a fold once, false branches not."""
    f = measured(_units(spark, d, {"/p/a.cpp": _text(DECISIONS)}, "/p/a.cpp").select("unit_ord", F.explode("functions").alias("f")).select("unit_ord", "f.name", "f.tokens"))
    return f.select(F.col("unit_ord").alias("p_partkey"), "name", F.col("complexity").alias("n"))


COUNTED = """int f() {{
  int s = 0;
  {array_join(transform(sequence(1, p_size % 9 + 1), i -> concat('s += ', i, ';')), ' ')}
#ifdef NEVER
  s += 99;
#endif
#define LOCAL s
  return s; // s
}}
"""


@query("SELECT p_partkey, 7::bigint AS distinct_operators, (3 + p_size % 9 + 1)::bigint AS distinct_operands, (8 + 2 * (p_size % 9 + 1))::bigint AS total_operators, (4 + 2 * (p_size % 9 + 1))::bigint AS total_operands FROM part")
def unit_halstead(spark, d):
    """Tokens of a function's own range: no false branch, no directive, no comment."""
    f = measured(_units(spark, d, {"/p/a.cpp": _text(COUNTED)}, "/p/a.cpp").select("unit_ord", F.explode("functions").alias("f")).select("unit_ord", "f.tokens"))
    return f.drop("complexity").withColumnRenamed("unit_ord", "p_partkey")


MACROS = """#define DEFINE(name, e) int name(int a) {{ if (a) return e; return 0; }}
#define TEST(a, b) struct a##_##b {{ void Body(); }}; void a##_##b::Body()
DEFINE(plain{K}, 1)
namespace n {{ DEFINE(deciding, a && {K}) }}
TEST(x, y{K}) {{ if (1) {{ auto l = [](int q) {{ return q ? 1 : 2; }}; }} }}
#define X(n) int n() {{ return 0; }}
#include "list.def"
#undef X
#define X(n)
#include "list.def"
"""


@query(
    """SELECT p_partkey, unnest([{'file': '/p/a.cpp', 'line': 3, 'name': 'plain' || p_partkey || '(int)', 'complexity': 1}, {'file': '/p/a.cpp', 'line': 4, 'name': 'n::deciding(int)', 'complexity': 2},
    {'file': '/p/a.cpp', 'line': 5, 'name': 'x_y' || p_partkey || '::Body()', 'complexity': 2}, {'file': '/p/a.cpp', 'line': 5, 'name': 'x_y' || p_partkey || '::Body()::(lambda)', 'complexity': 2},
    {'file': '/p/list.def', 'line': 1, 'name': 'one()', 'complexity': 1}, {'file': '/p/list.def', 'line': 2, 'name': 'two' || p_partkey || '()', 'complexity': 1}], recursive := true) FROM part"""
)
def macro_functions(spark, d):
    """Functions that macros make stand where the macro is used, and count what is written there."""
    sources = {"/p/a.cpp": _text(MACROS.replace("{K}", "{%s}" % K)), "/p/list.def": _text("X(one)\nX(two{%s})\n" % K)}
    f = measured(_units(spark, d, sources, "/p/a.cpp").select("unit_ord", F.explode("functions").alias("f")).select("unit_ord", "f.file", "f.line", "f.name", "f.tokens"))
    return f.select(F.col("unit_ord").alias("p_partkey"), "file", "line", "name", "complexity")


# Conditions, includes, arguments

CONDITIONS = """#include "again.h"
#define SECOND
#include "again.h"
#if __cplusplus >= 201703L
int modern() {{ return 1; }}
#else
int dated() {{ return 1; }}
#endif
#if defined(__linux__) && defined(__GNUC__) && !defined(_MSC_VER)
int here() {{ return 1; }}
#elif defined(_MSC_VER)
int there() {{ return 1; }}
#endif
#if SIZE > 25 && AT_LEAST({K} % 3, 1)
int large() {{ return 1; }}
#endif
#ifdef GONE
int gone() {{ return 1; }}
#endif
#ifdef FORCED
int forced() {{ return 1; }}
#endif
"""


@query(
    """WITH p AS (SELECT p_partkey, p_size, p_partkey % 4 AS m FROM part)
    SELECT p_partkey, unnest(list_concat(['first()', 'second()', CASE WHEN m IN (1, 3) THEN 'modern()' ELSE 'dated()' END, CASE WHEN m = 2 THEN 'there()' ELSE 'here()' END, 'forced()'], CASE WHEN p_size > 25 AND p_partkey % 3 >= 1 THEN ['large()'] ELSE [] END)) AS name FROM p"""
)
def unit_conditions(spark, d):
    """Branches taken by the driver's and the standard's own macros, -D, -U and -include, and a file included twice."""
    size = F.col("p_size").cast("string")
    gcc = lambda std: F.array(F.lit("g++"), F.lit(f"-std={std}"), F.concat(F.lit("-DSIZE="), size), F.lit("-D"), F.lit("GONE"), F.lit("-UGONE"), F.lit("-include"), F.lit("pre.h"), F.lit("a.cpp"))
    cl = F.array(F.lit("cl.exe"), F.lit("/std:c++14"), F.concat(F.lit("/DSIZE="), size), F.lit("/FIpre.h"), F.lit("/c"))
    m = F.col("p_partkey") % 4
    arguments = F.when(m == 0, gcc("c++11")).when(m == 1, gcc("gnu++20")).when(m == 2, cl).otherwise(gcc("c++17"))
    sources = {
        "/p/a.cpp": _text(CONDITIONS.replace("{K}", "{%s}" % K)), "/p/pre.h": F.lit("#define FORCED\n#define AT_LEAST(a, b) ((a) >= (b))\n"),
        "/p/again.h": F.lit("#ifndef SECOND\nint first() { return 1; }\n#else\nint second() { return 2; }\n#endif\n"),
    }
    return _units(spark, d, sources, "/p/a.cpp", arguments).select(F.col("unit_ord").alias("p_partkey"), F.explode("functions.name").alias("name"))


@query(
    """SELECT p_partkey, unnest(list_concat([{'src': '/p/src/a.cpp', 'dst': '/p/src/near.h'}, {'src': '/p/src/a.cpp', 'dst': '/p/inc/lib/x.hpp'}, {'src': '/p/src/near.h', 'dst': '/p/src/near.h'}, {'src': '/p/inc/lib/x.hpp', 'dst': '/p/src/near.h'}],
    CASE WHEN p_size % 2 = 0 THEN [{'src': '/p/src/a.cpp', 'dst': '/p/even.h'}] ELSE [] END), recursive := true) FROM part"""
)
def unit_includes(spark, d):
    """Inclusions, those that a guard skips too; none of a false branch, of a system folder, or out of the project."""
    sources = {
        "/p/src/a.cpp": _text('#include "near.h"\n#include <lib/x.hpp>\n#include "near.h"\n#include <sys.h>\n#include <vector>\n#include "/q/out.h"\n#if 0\n#include "never.h"\n#endif\n#if {p_size} % 2 == 0\n#define WHERE "../even.h"\n#include WHERE\n#endif\n'),
        "/p/src/near.h": F.lit("#ifndef NEAR\n#define NEAR\n#include \"near.h\"\n#endif\n"), "/p/inc/lib/x.hpp": F.lit('#pragma once\n#include "../../src/near.h"\n#include "x.hpp"\n').cast("string"),
        "/p/sys/sys.h": F.lit('#include "more.h"\n'), "/p/sys/more.h": F.lit(""), "/q/out.h": F.lit(""), "/p/even.h": F.lit(""), "/p/src/never.h": F.lit(""),
    }
    arguments = F.array(F.lit("c++"), F.lit("-I"), F.lit("../inc"), F.lit("-isystem../sys"))
    f = _units(spark, d, sources, "/p/src/a.cpp", arguments, "/p/build").select("unit_ord", F.explode("includes").alias("e"))
    return f.where("e.src <> e.dst or e.src not like '%x.hpp'").select(F.col("unit_ord").alias("p_partkey"), "e.src", "e.dst")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'c' ELSE 'c++' END AS language, CASE WHEN p_size % 2 = 0 THEN ['/w/b/inc', '/abs'] ELSE ['/w/b', '/w/inc'] END AS search, CASE WHEN p_size % 2 = 0 THEN ['/w/q'] ELSE [] END AS quote,
    CASE WHEN p_size % 2 = 0 THEN ['/w/b/s', '/w/b/late', '/res/include'] ELSE ['/w/b/ext', '/res/include'] END AS system, CASE WHEN p_size % 2 = 0 THEN ['A=' || p_size, 'B=1', 'C'] ELSE ['A=' || p_size, 'B=x=y'] END AS definitions,
    CASE WHEN p_size % 2 = 0 THEN ['pre.h'] ELSE ['all.h'] END AS forced FROM part"""
)
def unit_arguments(spark, d):
    """What either driver's command says, folders made absolute, in the order in which they are searched."""
    size = F.col("p_size").cast("string")
    gcc = F.array(*[F.lit(x) for x in ("gcc-13", "-isystem", "s", "-idirafter", "late", "-Iinc", "-iquote../q", "-I", "/abs/x/..")], F.concat(F.lit("-DA="), size), *[F.lit(x) for x in ("-D", "B", "-U", "C", "-include", "pre.h", "-x", "c", "a.cpp")])
    cl = F.array(*[F.lit(x) for x in (r"C:\bin\cl.exe", "/I.", "/I", "../inc", "-external:Iext")], F.concat(F.lit("/DA="), size), *[F.lit(x) for x in ("/D", "B=x=y", "/FIall.h", "a.cpp")])
    p = _t(spark, d, "part").select("p_partkey", F.lit("/w/b/a.cpp").alias("file"), F.lit("/w/b").alias("directory"), F.lit(None).cast("string").alias("command"), F.when(F.col("p_size") % 2 == 0, gcc).otherwise(cl).alias("arguments"))
    return units.normalised(p, "p_partkey", "/res")


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ['/p/a.cpp: ''gone.h'' file not found'] WHEN 1 THEN ['/p/a.cpp: #error no ' || p_partkey] WHEN 2 THEN ['/p/a.cpp: unterminated conditional directive']
    WHEN 3 THEN ['/p/a.cpp: #endif without #if', '/p/a.cpp: expected ''}'''] ELSE [] END AS errors FROM part"""
)
def unit_errors(spark, d):
    """Errors of a unit; warnings and what a false branch holds are none."""
    m = F.col("p_size") % 5
    bad = F.when(m == 0, F.lit('#include "gone.h"\n')).when(m == 1, _text("#error no {%s}\n" % K)).when(m == 2, F.lit("#if 1\nint x;\n")).when(m == 3, F.lit("#endif\nint f() {\n")).otherwise(F.lit("#warning w\n#if 0\n#error no\n#endif\n#include <gone>\n"))
    return _units(spark, d, {"/p/a.cpp": bad}, "/p/a.cpp").select(F.col("unit_ord").alias("p_partkey"), "errors")


@query(
    """SELECT p_partkey, i::bigint AS unit_ord, CASE i WHEN 0 THEN '/w/src/a' || p_partkey || '.c' WHEN 1 THEN '/abs/b.cc' ELSE '/w/c.f90' END AS file, '/w' AS directory, CASE i WHEN 0 THEN ['cc', '-DX=a b', 'src/a' || p_partkey || '.c'] WHEN 1 THEN ['c++', '-c', 'it''s'] ELSE ['f'] END AS arguments,
    i = 2 AS skipped FROM part, (SELECT unnest([0, 1, 2]) AS i)"""
)
def compile_commands(spark, d):
    """Databases of three entries in either form, their order kept, files made absolute and normal, other languages marked."""
    text = _text('[{{"directory": "/w", "file": "src/../src/./a{%s}.c", "arguments": ["cc", "-DX=a b", "src/a{%s}.c"]}},\n {{"directory": "/w", "file": "/abs//b.cc", "command": "c++ -c \\"it\'s\\""}}, {{"directory": "/w", "file": "c.f90", "arguments": ["f"], "output": "x"}}]' % (K, K))
    c = files.commands(_t(spark, d, "part").select("p_partkey", text.alias("text")))
    return units.split_commands(c).select("p_partkey", "unit_ord", "file", "directory", "arguments", (~paths.is_source(F.col("file"))).alias("skipped"))


MODULE_MAP = "# modules\n\nshop = **.example.com/**\r\n  net-en=**.example.net/en/**\n\tnet = **.example.net/**\nodd = a=b\norg = https://**.example.org/??/*\n"


@query(
    f"""SELECT page_id, CASE WHEN regexp_matches(url, '{paths.glob_to_regex('**.example.com/**')}') THEN 'shop' WHEN regexp_matches(url, '{paths.glob_to_regex('**.example.net/en/**')}') THEN 'net-en'
    WHEN regexp_matches(url, '{paths.glob_to_regex('**.example.net/**')}') THEN 'net' WHEN regexp_matches(url, '{paths.glob_to_regex('https://**.example.org/??/*')}') THEN 'org' ELSE '(unassigned)' END AS module FROM pages"""
)
def module_map_text(spark, d):
    """A module map as it is written: comments, white space of any kind, the first = of a line."""
    return _t(spark, d, "pages").select("page_id", paths.module_of(F.col("url"), files.module_rules(MODULE_MAP)).alias("module"))


# Declarations

API = """// banner

#ifndef H
#define H
/// Adds.
int add{K}(int a, int b);
int bare{K}(int a);
{element_at(array('/** T. */', '// T.', '', '/*! T. */', '//// T.'), p_size % 5 + 1)}
struct T{K} {{
  int x; ///< of x
  int y, z;
 private:
  int secret;
 public:
  /// m
  void m() const;
  T{K}() = default;
}};
static int internal(int);
/* Both. */
extern int one{K}, two{K};
/// S.
typedef struct {{ int code; }} status{K};
using alias{K} = double;
struct U{K} {{}} u{K}; // u
/// lost
#define BETWEEN
int after{K};
/// Of q. */
int p{K}; int q{K};
namespace {{ int anon; }}
namespace in {{ enum class E {{ a }}; const int fixed = 1; int (*handler)(int); class C {{ int hidden; public: int shown; }}; }}
int add{K}(int a, int b);
struct Forward;
#endif
"""
_API_ROWS = [
    ("function", "'add' || k || '(int, int)'", 6, "doxygen"), ("function", "'bare' || k || '(int)'", 7, "none"), ("type", "'T' || k", 9, "CASE m WHEN 0 THEN 'doxygen' WHEN 1 THEN 'plain' WHEN 2 THEN 'none' WHEN 3 THEN 'doxygen' ELSE 'plain' END"),
    ("field", "'T' || k || '::x'", 10, "doxygen"), ("field", "'T' || k || '::y'", 11, "none"), ("field", "'T' || k || '::z'", 11, "none"), ("method", "'T' || k || '::m()'", 16, "doxygen"),
    ("variable", "'one' || k", 21, "plain"), ("variable", "'two' || k", 21, "plain"), ("type_alias", "'status' || k", 23, "doxygen"), ("field", "'status' || k || '::code'", 23, "none"), ("type_alias", "'alias' || k", 24, "none"),
    ("type", "'U' || k", 25, "none"), ("variable", "'u' || k", 25, "plain"), ("variable", "'after' || k", 28, "none"), ("variable", "'p' || k", 30, "doxygen"), ("variable", "'q' || k", 30, "none"),
    ("type", "'in::E'", 32, "none"), ("variable", "'in::handler'", 32, "none"), ("type", "'in::C'", 32, "none"), ("field", "'in::C::shown'", 32, "none"),
]
_LITERAL = lambda s: s if s.startswith("CASE") else f"'{s}'"


@query(f"""SELECT k::bigint AS p_partkey, unnest([{', '.join(f"{{'kind': '{a}', 'name': {b}, 'line': {c}, 'style': {_LITERAL(e)}}}" for a, b, c, e in _API_ROWS)}], recursive := true) FROM (SELECT p_partkey::varchar AS k, p_size % 5 AS m FROM part)""")
def unit_api(spark, d):
    """Public declarations of a header, each declarator by itself, with the style of the comment that belongs to it."""
    facts = _units(spark, d, {"/p/a.hpp": _text(API.replace("{K}", "{%s}" % K))}, "/p/a.hpp")
    # the units' headers share a name: each is a file of its own
    of = lambda c, f: F.transform(c, lambda x: x.withField("file", F.concat(F.lit("/p/"), F.col("unit_ord").cast("string"))))
    a = declarations(facts.withColumns({"api": of("api", "file"), "marks": of("marks", "file")}))
    return a.select(F.substring("file", 4, 20).cast("bigint").alias("p_partkey"), "kind", "name", "line", "style")


# Lines

OPENERS = "\ufeff// bom\nint a; /\\\n/ spliced\n/*/ still\n */ int b;\nchar q = '\\''; // c\nconst char *s = \"a\\\"/*\";\n/\\\r\n* both\n*/\nint n = 0x1'F + 1'0; /* c\n\t\v\f\r\nx */\nauto r = uR\"x(//\\\n)x\";\n'\n// after an open quote\nint \\\n\\\n;\n"


@query("SELECT p_partkey, (20 + p_size % 3)::bigint AS physical, 2::bigint AS blank, (8 + p_size % 3)::bigint AS comment, 10::bigint AS code FROM part")
def loc_openers(spark, d):
    """Spliced openers, `/*/`, escapes, a byte order mark, separators, raw strings, open quotes, and blank lines of all white space."""
    src = _t(spark, d, "part").select("p_partkey", F.concat(F.lit(OPENERS), F.expr("repeat('/**/\n', p_size % 3)")).alias("content"))
    return lines.line_counts(src, path="p_partkey").withColumnRenamed("file", "p_partkey")


# Coverage files

_COV = "FROM (SELECT o_orderkey AS k, (o_orderkey % 5)::bigint AS m FROM orders)"


@query(f"SELECT '/w/o' || k || '.c' AS path, (2 + m)::bigint AS lines, (1 + m)::bigint AS lines_covered, 4::bigint AS branches, (2 + (m > 0)::int)::bigint AS branches_covered, 3::bigint AS functions, 2::bigint AS functions_covered {_COV}")
def lcov_records(spark, d):
    """Every record of the line protocol, two files of one path, CRLF, checksums, names with commas, records that don't count."""
    one = "TN:t\nSF:/w/o{k}.c\nVER:1\nFN:3,main\nFN:9,12,late(int, int)\nFNDA:2,main\nFNL:0,5\nFNA:0,1,leader\nFNF:9\nDA:3,1,abc\n{repeat_da}BRDA:3,0,0,-\nBRDA:3,0,1,4\nBRDA:4,e0,0,{m}\nLF:9\nLH:9\nend_of_record\n"
    two = "SF:/w/x/../o{k}.c\r\nDA:3,0\r\nDA:90,0\r\nBRDA:3,0,0,1\r\nBRDA:5,0,0,0\r\nend_of_record\r\n"
    text = _text((one + two).replace("{repeat_da}", "{array_join(transform(sequence(10, 10 + int(m)), i -> if(i = 10, '', concat('DA:', i, ',18446744073709551615\\n'))), '')}").replace("{k}", "{cast(k as string)}").replace("{m}", "{cast(m as string)}"))
    t = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("m")).select(F.concat(F.lit("/t/"), F.col("k").cast("string"), F.lit(".info")).alias("source"), text.alias("text"))
    from ..operators import coverage as cov

    return cov.merge(coverage_files.read_coverage(t)[0])


@query(f"SELECT '/cwd/g' || k || '.h' AS path, 2::bigint AS lines, (1 + (m > 2)::int)::bigint AS lines_covered, 3::bigint AS branches, (1 + (m > 0)::int)::bigint AS branches_covered, 2::bigint AS functions, (1 + (m > 0)::int)::bigint AS functions_covered {_COV}")
def gcov_documents(spark, d):
    """Documents of either version, one a line; branches by blocks or by place."""
    first = '{{"format_version": "2", "gcc_version": "14", "current_working_directory": "/cwd", "files": [{{"file": "g{k}.h", "functions": [{{"name": "_Zf", "demangled_name": "f(int, int)", "execution_count": 3}}], "lines": [{{"line_number": 4, "count": 1, "branches": [{{"count": 0, "source_block_id": 2, "destination_block_id": 3}}, {{"count": 5, "source_block_id": 2, "destination_block_id": 4}}]}}]}}]}}'
    second = '{{"format_version": "1", "current_working_directory": "/cwd/sub", "files": [{{"file": "../g{k}.h", "functions": [{{"name": "g", "execution_count": {m} }}, {{"name": "_Zf", "demangled_name": "f(int, int)", "execution_count": 0}}], "lines": [{{"line_number": 4, "count": 0, "branches": [{{"count": {m} }}]}}, {{"line_number": 5, "count": {if(m > 2, \'1\', \'0\')}, "branches": []}}]}}]}}'
    text = _text(first.replace("{k}", "{cast(k as string)}") + "\n" + second.replace("{k}", "{cast(k as string)}").replace("{m}", "{cast(m as string)}") + "\n")
    t = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("m")).select(F.lit("/t/x.gcov.json").alias("source"), text.alias("text"))
    from ..operators import coverage as cov

    return cov.merge(coverage_files.read_coverage(t)[0])


@query(f"SELECT '/w/l' || k || '.c' AS path, (20 + m)::bigint AS lines, 18::bigint AS lines_covered, 4::bigint AS branches, m AS branches_covered, 1::bigint AS functions, 0::bigint AS functions_covered {_COV}")
def llvm_totals(spark, d):
    """A tool's own totals are taken as they are; a file with nothing but zeros isn't listed."""
    body = '{{"filename": "/w/./{n}", "summary": {{"lines": {{"count": {a}, "covered": {b} }}, "branches": {{"count": {c}, "covered": {e} }}, "functions": {{"count": {f}, "covered": 0}}}}}}'
    fill = lambda **kw: body if not kw else _filled(body, kw)
    some = fill(n="l{cast(k as string)}.c", a="{cast(20 + m as string)}", b="18", c="4", e="{cast(m as string)}", f="1")
    none = fill(n="z{cast(k as string)}.c", a="0", b="0", c="0", e="0", f="0")
    text = _text('  {{"data": [{{"files": [' + some + ", " + none + ']}}], "type": "llvm.coverage.json.export", "version": "2.0.1"}}')
    t = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("m")).select(F.lit("/t/x.json").alias("source"), text.alias("text"))
    from ..operators import coverage as cov

    hits, totals = coverage_files.read_coverage(t)
    return cov.with_totals(cov.merge(hits), totals)


def _filled(body: str, kw: dict[str, str]) -> str:
    for k, v in kw.items():
        body = body.replace("{" + k + "}", v)
    return body


@query(f"SELECT k AS o_orderkey, CASE m % 3 WHEN 0 THEN 'lcov' WHEN 1 THEN 'gcov' ELSE 'llvm' END AS form {_COV}")
def sniffed_forms(spark, d):
    m = F.col("o_orderkey") % 5 % 3
    text = F.when(m == 0, "TN:\nSF:{\n").when(m == 1, ' \n\t{"format_version": "2"}').otherwise('{"data": [], "type": "llvm.coverage.json.export"}')
    return _t(spark, d, "orders").select("o_orderkey", coverage_files.sniff(text).alias("form"))


# A project

MODULES = "low = r0/**\nlow = r1/**\nhigh = r?/**\n"
_N = """n AS (SELECT n_nationkey::bigint AS k, n_regionkey::bigint AS r, (n_nationkey % 7)::bigint AS m, n_nationkey % 4 = 3 AS t, CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey + 1 WHEN n_nationkey < 10 THEN n_nationkey - 4 END AS k2 FROM nation),
    h AS (SELECT a.*, 'r' || a.r || '/n' || a.k || '.hpp' AS hpp, CASE WHEN a.t THEN 'tests/n' || a.k || '_test.cpp' ELSE 'r' || a.r || '/n' || a.k || '.cpp' END AS cpp, 'r' || b.r || '/n' || b.k || '.hpp' AS hpp2 FROM n a LEFT JOIN n b ON a.k2 = b.k),
    e AS (SELECT cpp AS src, hpp AS dst FROM h UNION ALL SELECT hpp, hpp2 FROM h WHERE hpp2 IS NOT NULL),
    l AS (SELECT cpp AS file, true AS parsed, 6 + m AS physical, 1::bigint AS blank, 1::bigint AS comment, 4 + m AS code FROM h
      UNION ALL SELECT hpp, true, 5::bigint, ((hpp2 IS NULL)::int + k % 2)::bigint, (1 - k % 2)::bigint, (3 + (hpp2 IS NOT NULL)::int)::bigint FROM h UNION ALL SELECT 'misc/g' || r_regionkey || '.c', false, 1::bigint, 0::bigint, 0::bigint, 1::bigint FROM region),
    f AS (SELECT cpp AS file, 3::int AS line, 5::int AS "column", 'function' AS kind, 'f' || k || '(int)' AS name, (1 + m)::int AS complexity, (5 + 2 * (m > 0)::int)::bigint AS n1, 3 + m AS n2, 6 + 5 * m AS t1, 3 + 3 * m AS t2 FROM h),
    a AS (SELECT hpp AS file, k, unnest([{'line': 4, 'kind': 'function', 'name': 'f' || k || '(int)', 'style': CASE WHEN k % 2 = 0 THEN 'doxygen' ELSE 'none' END}, {'line': 5, 'kind': 'type', 'name': 'S' || k, 'style': 'none'}, {'line': 5, 'kind': 'field', 'name': 'S' || k || '::v', 'style': 'none'}], recursive := true) FROM h)"""
_MOD = "CASE WHEN regexp_matches({0}, '^r[01]/') THEN 'low' WHEN regexp_matches({0}, '^r[0-9]/') THEN 'high' ELSE '(unassigned)' END"
_mod = _MOD.format


def _project(spark, d, cover: bool = False) -> Project:
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    n = n.withColumn("k2", F.expr("case when k % 5 <> 4 then k + 1 when k < 10 then k - 4 end"))
    n = n.join(n.select(F.col("k").alias("k2"), F.col("r").alias("r2")), "k2", "left").withColumns({"m": F.expr("int(k % 7)"), "t": F.expr("k % 4 = 3")})
    cpp = F.expr("if(t, concat('/p/tests/n', k, '_test.cpp'), concat('/p/r', r, '/n', k, '.cpp'))")
    body = _text(
        '#include "{if(t, concat(\'../r\', r, \'/\'), \'\')}n{string(k)}.hpp"\n\nint f{string(k)}(int a) {{\n{if(m = 0, \'\', array_join(transform(sequence(1, greatest(m, 1)), i -> concat(\'  if (a == \', i, \') return \', i, \'; // i\n\')), \'\'))}  /* end */\n  return 0;\n}}\n'
    )
    head = _text("#pragma once\n{if(r2 is null, '', concat('#include \"../r', r2, '/n', k2, '.hpp\"'))}\n{if(k % 2 = 0, '/// Doc.', '')}\nint f{string(k)}(int a);\nstruct S{string(k)} {{ int v; }};\n")
    lone = _t(spark, d, "region").select(F.expr("concat('/p/misc/g', r_regionkey, '.c')").alias("path"), F.lit("int g;\n").alias("content"))
    own = n.select(cpp.alias("path"), body.alias("content")).union(n.select(F.expr("concat('/p/r', r, '/n', k, '.hpp')"), head)).union(lone)
    entry = F.struct(F.lit("/p/build").alias("directory"), cpp.alias("file"), F.array(F.lit("c++"), F.lit("-c")).alias("arguments"))
    more = [F.struct(F.lit("/p/build").alias("directory"), F.lit(x).alias("file"), F.array(F.lit("c++"), F.lit("-c")).alias("arguments")) for x in ("old.f90", "gen.cpp")]
    db = n.agg(F.to_json(F.concat(F.array_sort(F.collect_list(entry)), F.array(*more))).alias("text"))
    text = F.concat(F.lit("SF:"), F.regexp_replace(cpp, "^/p/", "/ci/"), F.lit("\nDA:3,1\nDA:4,0\nFN:3,f\nFNDA:1,f\nend_of_record\nSF:/usr/x\nDA:1,1\nend_of_record\n"))
    coverage = n.select(F.concat(F.lit("/ci/"), F.col("k").cast("string")).alias("source"), text.alias("text")) if cover else None
    return Project(spark, Options("/p", "/p/build", None, files.module_rules(MODULES), path_maps=[("/ci", "/p")], flagged=3, high=5), Given(own, db, coverage))


@query(f"WITH {_N} SELECT file, {_mod('file')} AS module, CASE WHEN starts_with(file, 'tests/') THEN 'test' ELSE 'production' END AS role, CASE WHEN parsed THEN 'yes' ELSE 'no' END AS parsed, physical, blank, comment, code FROM l")
def project_files(spark, d):
    return report.text_columns(report.tables(_project(spark, d))["files"].select(*report.TABLES["files"]), ["parsed"])


_V = "((t1 + t2) * log2(n1 + n2))::double"
_D = "(n1 * t2 / (2.0::double * n2))"


@query(
    f"""WITH {_N} SELECT file, line, "column", kind, name, {_mod('file')} AS module, complexity, CASE WHEN complexity > 5 THEN 'high' WHEN complexity > 3 THEN 'flagged' ELSE 'ok' END AS rating, n1 AS distinct_operators, n2 AS distinct_operands, t1 AS total_operators, t2 AS total_operands,
    round({_V}, 6) AS volume, round({_D}, 6) AS difficulty, round({_V} * {_D}, 6) AS effort FROM f"""
)
def project_functions(spark, d):
    f = _project(spark, d).functions().select(*report.TABLES["functions"])
    return f.withColumns({c: F.round(c, 6) for c in ("volume", "difficulty", "effort")})


def _summary_sql(where: str, module: str, total: str) -> str:
    return f"""SELECT {module} AS module, count(*) AS functions, avg(complexity)::double AS mean, median(complexity)::double AS median, quantile_disc(complexity, 0.9)::bigint AS p90, max(complexity)::bigint AS max, count(*) FILTER (complexity > 3) AS flagged,
    count(*) FILTER (complexity > 5) AS high, round(sum({_V}), 4) AS volume, round(sum({_V} * {_D}), 4) AS effort, {total} AS is_total FROM f {where}"""


@query(f"WITH {_N} {_summary_sql('GROUP BY 1', _mod('file'), 'false')} UNION ALL {_summary_sql('', chr(39) + 'TOTAL' + chr(39), 'true')}")
def project_function_summary(spark, d):
    s = _project(spark, d).function_summary().withColumnRenamed("count", "functions")
    return s.withColumns({c: F.round(c, 4) for c in ("volume", "effort")})


@query(f"WITH {_N} SELECT file, line::int AS line, kind, name, {_mod('file')} AS module, style <> 'none' AS documented, style FROM a")
def project_api(spark, d):
    return _project(spark, d).api().select("file", "line", "kind", "name", "module", "documented", "style")


@query(
    f"""WITH {_N}, s AS (SELECT {_mod('file')} AS module, style FROM a)
    SELECT module, count(*) AS entities, count(*) FILTER (style <> 'none') AS documented, count(*) FILTER (style <> 'none') * 100.0::double / count(*) AS percent, count(*) FILTER (style = 'doxygen') AS doxygen, false AS is_total FROM s GROUP BY module
    UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (style <> 'none'), count(*) FILTER (style <> 'none') * 100.0::double / count(*), count(*) FILTER (style = 'doxygen'), true FROM s"""
)
def project_api_summary(spark, d):
    return _project(spark, d).api_summary()


_REACH = "r(a, b) AS (SELECT src, dst FROM {e} WHERE src <> dst UNION SELECT r.a, e.dst FROM r JOIN {e} e ON r.b = e.src), c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS low FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a), q AS (SELECT node, low, dense_rank() OVER (ORDER BY low)::int AS cycle FROM c)"


@query(
    f"""WITH RECURSIVE {_N}, {_REACH.format(e='e')}, v AS (SELECT cpp AS file FROM h UNION SELECT hpp FROM h)
    SELECT file, {_mod('file')} AS module, (SELECT count(*) FROM e WHERE dst = file)::bigint AS fan_in, (SELECT count(*) FROM e WHERE src = file)::bigint AS fan_out, cycle FROM v LEFT JOIN q ON q.node = file"""
)
def project_include_files(spark, d):
    return _project(spark, d).include_graph()["files"]


@query(f"WITH {_N} SELECT src AS \"from\", dst AS \"to\", {_mod('src')} AS from_module, {_mod('dst')} AS to_module FROM e")
def project_include_edges(spark, d):
    return _project(spark, d).include_graph()["edges"]


@query(f"WITH RECURSIVE {_N}, {_REACH.format(e='e')} SELECT 'file' AS level, cycle, count(*) AS size, string_agg(node, ';' ORDER BY node) AS members FROM q GROUP BY cycle")
def project_include_cycles(spark, d):
    return _project(spark, d).include_graph()["cycles"].where("level = 'file'")


_ME = f"me AS (SELECT DISTINCT {_mod('src')} AS src, {_mod('dst')} AS dst FROM e WHERE {_mod('src')} <> {_mod('dst')}), mv AS (SELECT {_mod('f')} AS module, count(*) AS files FROM (SELECT cpp AS f FROM h UNION SELECT hpp FROM h) GROUP BY 1)"


@query(f"WITH RECURSIVE {_N}, {_ME}, {_REACH.format(e='me')} SELECT module, files, (SELECT count(*) FROM me WHERE dst = module)::bigint AS fan_in, (SELECT count(*) FROM me WHERE src = module)::bigint AS fan_out, cycle FROM mv LEFT JOIN q ON q.node = module")
def project_include_modules(spark, d):
    return _project(spark, d).include_graph()["modules"]


@query(f"WITH {_N} SELECT (SELECT count(*) FROM h) AS units, 1::bigint AS skipped, 1::bigint AS in_build, 0::bigint AS units_with_errors")
def project_totals(spark, d):
    return _project(spark, d).totals()


_CV = "cv AS (SELECT cpp AS file, 2::bigint AS lines, 1::bigint AS lines_covered, 0::bigint AS branches, 0::bigint AS branches_covered, 1::bigint AS functions, 1::bigint AS functions_covered FROM h)"


@query(f"WITH {_N}, {_CV} SELECT {_mod('file')} AS module, count(*) AS files, sum(lines)::bigint AS lines, sum(lines_covered)::bigint AS lines_covered, 50::double AS line_percent, 100::double AS function_percent, false AS is_total FROM cv GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), sum(lines)::bigint, sum(lines_covered)::bigint, 50, 100, true FROM cv")
def project_coverage_summary(spark, d):
    """Records of another place are mapped into the project; those outside don't count."""
    return _project(spark, d, True).coverage_summary().select("module", "files", "lines", "lines_covered", "line_percent", "function_percent", "is_total")


def _rows_sql(key: str, g: str) -> str:
    """Module rows as CSV lines; key is a module's expression over `file`, g the group."""
    return f"""SELECT {g} AS module, count(*) AS files, count(*) FILTER (parsed) AS parsed, sum(CASE WHEN tst THEN 0 ELSE code END)::bigint AS production_code, sum(CASE WHEN tst THEN code ELSE 0 END)::bigint AS test_code FROM (SELECT *, {key} AS mk, starts_with(file, 'tests/') AS tst FROM l) GROUP BY 1"""


@query(
    f"""WITH {_N}, x AS ({_rows_sql(_mod('file'), 'mk')} UNION ALL {_rows_sql("'TOTAL'", 'mk')}), y AS (SELECT {_mod('file')} AS module, complexity FROM f WHERE NOT starts_with(file, 'tests/')),
    z AS (SELECT x.*, (SELECT count(*) FROM y WHERE x.module IN (y.module, 'TOTAL')) AS functions, coalesce((SELECT avg(complexity) FROM y WHERE x.module IN (y.module, 'TOTAL')), 0)::double AS mean, coalesce((SELECT median(complexity) FROM y WHERE x.module IN (y.module, 'TOTAL')), 0)::double AS median,
      (SELECT count(*) FROM a WHERE x.module IN ({_mod('a.file')}, 'TOTAL')) AS api, (SELECT count(*) FROM a WHERE style <> 'none' AND x.module IN ({_mod('a.file')}, 'TOTAL')) AS documented FROM x)
    SELECT module || ',' || files || ',' || parsed || ',' || production_code || ',' || test_code || ',' || functions || ',' || printf('%.2f', mean) || ',' || printf('%.1f', median) || ',' || api || ',' || documented || ',' || printf('%.1f', CASE WHEN api = 0 THEN 0 ELSE 100.0 * documented / api END) AS line FROM z"""
)
def project_module_csv(spark, d):
    """Module rows as the lines of a CSV table: decimals as it shows them."""
    cols = ["module", "files", "files_parsed", "production_code", "test_code", "functions", "complexity_mean", "complexity_median", "api", "documented", "documented_percent"]
    return report.csv_lines(_project(spark, d).module_rows(), cols)


@query(f"WITH {_N} SELECT '  \"' || src || '\" -> \"' || dst || '\"' || CASE WHEN regexp_matches(src, '[.]hpp$') AND regexp_extract(src, 'n([0-9]+)', 1)::int < 10 THEN ' [color=red]' ELSE '' END || ';' AS line FROM e")
def project_dot_edges(spark, d):
    """The drawing's edges, those within a cycle coloured."""
    text = _project(spark, d).dot()
    return spark.createDataFrame([(x,) for x in text.splitlines() if "->" in x], "line string")


@query(
    f"""WITH {_N}, x AS ({_rows_sql(_mod('file'), 'mk')})
    SELECT module, files, parsed AS files_parsed, production_code AS production, test_code AS test, (SELECT count(*) FROM a WHERE {_mod('a.file')} = module) AS declarations, (SELECT count(*) FROM f WHERE NOT starts_with(file, 'tests/') AND {_mod('file')} = module) AS functions, true AS coverage_is_null FROM x"""
)
def project_report_json(spark, d):
    """The JSON document's module objects, read back from its text."""
    p = _project(spark, d)
    text = spark.createDataFrame([(report.json_text(report.document(p, report.tables(p))),)], "j string")
    shape = "modules array<struct<module string, files bigint, files_parsed bigint, lines struct<production struct<code bigint>, test struct<code bigint>>, complexity struct<functions bigint>, documentation struct<declarations bigint>, coverage struct<lines bigint>>>"
    m = text.select(F.explode(F.from_json("j", shape)["modules"]).alias("m"))
    return m.select("m.module", "m.files", "m.files_parsed", F.col("m.lines.production.code").alias("production"), F.col("m.lines.test.code").alias("test"), "m.documentation.declarations", "m.complexity.functions", F.col("m.coverage").isNull().alias("coverage_is_null"))


@query(
    f"""WITH {_N}, c AS (SELECT {_mod('src')} AS a, {_mod('dst')} AS b, count(*) AS n FROM e GROUP BY ALL), v AS (SELECT unnest(['(unassigned)', 'high', 'low']) AS module)
    SELECT '| `' || module || '` |' || string_agg(' ' || coalesce(n, 0) || ' |', '' ORDER BY w) AS line FROM v CROSS JOIN (SELECT module AS w FROM v) LEFT JOIN c ON c.a = module AND c.b = w GROUP BY module"""
)
def project_markdown_matrix(spark, d):
    """The report's matrix of module coupling, as its text has it."""
    p = _project(spark, d)
    text = report.markdown(p, report.tables(p))
    part = text[text.index("to each module (columns)") :]
    return spark.createDataFrame([(x,) for x in part.splitlines() if x.startswith("| `")], "line string")


@query("SELECT p_partkey, p_name || ',' || p_size || ',' || printf('%.2f', p_retailprice) || ',' || CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END || ',' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '\"a,\"\"b\"' END AS line FROM part")
def csv_lines(spark, d):
    """Fields as a CSV table shows them: decimals, flags, missing values, quoting where it is needed."""
    p = _t(spark, d, "part").select("p_partkey", "p_name", "p_size", F.col("p_retailprice").alias("volume"), (F.col("p_size") % 2 == 0).alias("even"), F.when(F.col("p_size") % 3 != 0, F.lit('a,"b')).alias("odd"))
    return report.csv_lines(p, ["p_name", "p_size", "volume", "even", "odd"], "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE printf('%.1f %%', 100.0 * (p_size % 5) / (p_size % 7)) END AS percent FROM part")
def percent_texts(spark, d):
    """A share as a report shows it; n/a of nothing."""
    return _t(spark, d, "part").select("p_partkey", measures.percent_shown(F.col("p_size") % 5, F.col("p_size") % 7).alias("percent"))


@query("WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT 'c' || c_custkey FROM customer) SELECT node, coalesce(i.n, 0)::bigint AS fan_in, coalesce(o.n, 0)::bigint AS fan_out FROM n LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON i.dst = node LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = node")
def isolated_fan(spark, d):
    """Nodes without an edge are listed with zeros."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = graph.distinct_edges(_t(spark, d, "lineitem").select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst")))
    return graph.fan(e, _t(spark, d, "customer").select(name("c", "c_custkey").alias("node")))


# Table functions


@query(
    """WITH k AS (SELECT p_partkey, list_concat(['comment', 'blank', 'code', 'code', 'code', 'comment', 'comment', 'code'], list_transform(range(0, p_size % 4), lambda i: 'comment'), CASE WHEN p_size % 2 = 0 THEN ['blank'] ELSE ['code', 'blank', 'code'] END) AS ks FROM part)
    SELECT p_partkey, unnest(range(1, len(ks) + 1))::int AS line, unnest(ks) AS kind FROM k"""
)
def lines_by_sql(spark, d):
    """A source's lines by a table function in SQL."""
    tables.register(spark)
    _sources(spark, d).createOrReplaceTempView("plumbline_sources")
    return spark.sql("SELECT s.p_partkey, t.line, t.kind FROM plumbline_sources s, LATERAL classify_lines(s.content) t")


@query(
    """SELECT p_partkey, unnest([{'place': 0, 'kind': 'keyword', 'spelling': 'return'}, {'place': 1, 'kind': 'identifier', 'spelling': 'v' || p_partkey}, {'place': 2, 'kind': 'punctuation', 'spelling': '<=>'}, {'place': 3, 'kind': 'literal', 'spelling': p_size || '''000u'},
    {'place': 4, 'kind': 'punctuation', 'spelling': ';'}, {'place': 5, 'kind': 'comment', 'spelling': '// é'}, {'place': 6, 'kind': 'literal', 'spelling': 'u8R"x(a;b)x"'}], recursive := true) FROM part"""
)
def tokens_by_sql(spark, d):
    """A source's tokens by a table function in SQL."""
    tables.register(spark)
    text = _text('return v{%s}<=>{string(p_size)}\'000u; // é\nu8R"x(a;b)x"' % K)
    _t(spark, d, "part").select("p_partkey", text.alias("content")).createOrReplaceTempView("plumbline_texts")
    return spark.sql("SELECT s.p_partkey, t.place, t.kind, t.spelling FROM plumbline_texts s, LATERAL source_tokens(s.content) t")
