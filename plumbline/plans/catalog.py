"""Named queries of the metrics operators over the driver's tables, each with its SQL.

The tables hold no source code, so each operator runs over a table of the same shape: paths are made of urls and
sources, entities of orders and events, graphs of who supplies whom.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures, paths
from ..operators import api as api_ops
from ..operators import coverage as cov
from ..operators import dedupe, graph, lines, ranges, stats, summary, tokens, topk
from ..sources import coverage_files
from ..sources.dealing import dealt
from .registry import query
from .registry import table as _t

def _describe_sql(v: str) -> str:
    return (
        f"count({v})::bigint AS count, coalesce(avg({v}), 0)::double AS mean, coalesce(median({v}), 0)::double AS median, coalesce(quantile_disc({v}, 0.9), 0)::bigint AS p90,"
        f" coalesce(max({v}), 0)::bigint AS max, count(*) FILTER ({v} > 10) AS flagged, count(*) FILTER ({v} > 20) AS high"
    )


# Distributions


@query(f"SELECT l_returnflag, {_describe_sql('v')} FROM (SELECT l_returnflag, l_quantity::bigint AS v FROM lineitem) GROUP BY 1")
def distribution_by_group(spark, d):
    return stats.describe(_t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("v")), ["l_returnflag"], "v")


@query(
    f"""WITH a AS (SELECT l_returnflag AS module, l_quantity::bigint AS v, l_extendedprice AS e FROM lineitem)
    SELECT module, {_describe_sql('v')}, round(sum(e), 2) AS volume, false AS is_total FROM a GROUP BY module
    UNION ALL SELECT 'TOTAL', {_describe_sql('v')}, round(sum(e), 2), true FROM a"""
)
def distribution_with_total(spark, d):
    a = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("module"), F.col("l_quantity").cast("bigint").alias("v"), F.col("l_extendedprice").alias("e"))
    return stats.describe_with_total(a, "module", "v", F.round(F.sum("e"), 2).alias("volume"))


@query(
    f"""SELECT 'TOTAL' AS module, {_describe_sql('v')}, true AS is_total FROM (SELECT l_quantity::bigint AS v FROM lineitem WHERE l_quantity < 0)"""
)
def distribution_of_nothing(spark, d):
    a = _t(spark, d, "lineitem").where("l_quantity < 0").select(F.col("l_returnflag").alias("module"), F.col("l_quantity").cast("bigint").alias("v"))
    return stats.describe_with_total(a, "module", "v")


@query("SELECT CASE WHEN l_quantity > 20 THEN 'high' WHEN l_quantity > 10 THEN 'flagged' ELSE 'ok' END AS rating, count(*) AS functions FROM lineitem GROUP BY 1")
def rating_counts(spark, d):
    return _t(spark, d, "lineitem").groupBy(measures.rating(F.col("l_quantity")).alias("rating")).agg(F.count(F.lit(1)).alias("functions"))


# Naming

RULES = [("shop", "**.example.com/**"), ("net-en", "**.example.net/en/**"), ("net", "**.example.net/**"), ("org", "https://**.example.org/??/*")]
TEST_GLOBS = ("**page=2**", "http://**")


def _module_sql(path: str, rules=RULES) -> str:
    q = lambda g: paths.glob_to_regex(g).replace("'", "''")
    return f"CASE {' '.join(f'''WHEN regexp_matches({path}, '{q(g)}') THEN '{m}' ''' for m, g in rules)} ELSE '{paths.UNASSIGNED}' END"


@query(f"SELECT page_id, url, {_module_sql('url')} AS module FROM pages")
def module_of_url(spark, d):
    return _t(spark, d, "pages").select("page_id", "url", paths.module_of(F.col("url"), RULES).alias("module"))


_TEST_SQL = "(" + " OR ".join(f"regexp_matches(url, '{paths.glob_to_regex(g)}')" for g in TEST_GLOBS) + ")"


@query(
    f"""SELECT {_module_sql('url')} AS module, count(*) AS files, coalesce(sum(length(html)) FILTER (NOT {_TEST_SQL}), 0)::bigint AS production, coalesce(sum(length(html)) FILTER ({_TEST_SQL}), 0)::bigint AS test
    FROM pages GROUP BY 1"""
)
def role_split(spark, d):
    p = _t(spark, d, "pages").select(paths.module_of(F.col("url"), RULES).alias("module"), paths.role_of(F.col("url"), TEST_GLOBS).alias("role"), F.length("html").cast("bigint").alias("n"))
    each = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(r)
    return p.groupBy("module").agg(F.count(F.lit(1)).alias("files"), each("production"), each("test"))


MAPS = [("/src1", "/lib/one"), ("/src2/en", "/lib/english"), ("/src2", "/lib/two"), ("/src3/de/", "/")]


@query(
    """WITH p AS (SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id AS path FROM documents)
    SELECT doc_id, path, CASE WHEN path = '/src1' OR starts_with(path, '/src1/') THEN '/lib/one' || substr(path, 6) WHEN path = '/src2/en' OR starts_with(path, '/src2/en/') THEN '/lib/english' || substr(path, 9)
    WHEN path = '/src2' OR starts_with(path, '/src2/') THEN '/lib/two' || substr(path, 6) WHEN path = '/src3/de' OR starts_with(path, '/src3/de/') THEN substr(path, 9) ELSE path END AS mapped,
    path = '/src1/en' OR starts_with(path, '/src1/en/') AS inside FROM p"""
)
def path_remap(spark, d):
    p = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return p.select("doc_id", "path", paths.remap(F.col("path"), MAPS).alias("mapped"), paths.is_within(F.col("path"), "/src1/en").alias("inside"))


@query("SELECT doc_id, '/' || source || '/' || lang || '/x' AS path FROM documents")
def normal_paths(spark, d):
    p = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("/../"), "source", F.lit("//./old/../"), "lang", F.lit("/y/.././x/")).alias("path"))
    return p.select("doc_id", paths.normal(F.col("path")).alias("path"))


@query(
    """WITH e AS (SELECT lower(regexp_extract(url, '[^/.][^/]*\\.([^./]*)$', 1)) AS ext FROM pages)
    SELECT count(*) AS units, count(*) FILTER (ext NOT IN ('c', 'h', 'cc', 'cp', 'cpp', 'cxx', 'c++', 'hh', 'hpp', 'hxx', 'h++', 'inl', 'ipp', 'tpp', 'cppm')) AS skipped, count(*) FILTER (ext = 'html') AS html FROM e"""
)
def plan_filter_counts(spark, d):
    p = _t(spark, d, "pages").select(F.col("url"))
    return p.agg(F.count(F.lit(1)).alias("units"), F.count_if(~paths.is_source(F.col("url"))).alias("skipped"), F.count_if(paths.extension(F.col("url")) == "html").alias("html"))


# Deduplication and top lists


@query("SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins(spark, d):
    return dedupe.first_wins(_t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, d):
    return topk.top(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), topk.COMPLEXITY, "o_totalprice", "o_orderkey")


@query("SELECT least(count(*), 50)::bigint AS shown, count(*) AS \"all\" FROM labels WHERE toxic = 1")
def shown_of(spark, d):
    return topk.shown(_t(spark, d, "labels").where("toxic = 1"), topk.UNDOCUMENTED)


# Coverage

COVER_RULES = [("one", "1*"), ("two", "2?"), ("three", "3*")]


def _hits(spark, d) -> DataFrame:
    """Events as hits: a user is a file, k a line, the floor of value its hits."""
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("user_id").cast("string").alias("path"), F.lit("line").alias("entity"), k.alias("line"), F.lit(None).cast("string").alias("id"), F.floor("value").cast("decimal(20,0)").alias("hits"), "event_type", "event_id")


_HITS_SQL = "SELECT user_id::varchar AS path, (props->>'$.k')::bigint AS line, floor(value) AS hits, event_type, event_id FROM events"
_MERGED_SQL = f"SELECT path, count(*) AS lines, count(*) FILTER (c) AS covered FROM (SELECT path, line, bool_or(hits > 0) AS c FROM ({_HITS_SQL}) GROUP BY path, line) GROUP BY path"


@query(f"SELECT path, lines, covered AS lines_covered FROM ({_MERGED_SQL})")
def coverage_merge(spark, d):
    return cov.merge(_hits(spark, d)).select("path", "lines", "lines_covered")


@query(
    f"""SELECT path, count(*) AS branches, count(*) FILTER (c) AS branches_covered FROM (SELECT path, line, CASE WHEN line % 2 = 0 THEN line || '>' || event_type ELSE (event_id % 4)::varchar END AS id, bool_or(hits > 0) AS c
    FROM ({_HITS_SQL}) GROUP BY ALL) GROUP BY path"""
)
def branch_identity(spark, d):
    block = F.when(F.col("line") % 2 == 0, F.col("event_type"))
    h = _hits(spark, d).withColumns({"entity": F.lit("branch"), "id": cov.branch_id(F.col("line"), block, F.col("event_id") % 4)})
    return cov.merge(h).select("path", "branches", "branches_covered")


@query(
    f"""WITH m AS (SELECT {_module_sql('path', COVER_RULES)} AS module, lines, covered FROM ({_MERGED_SQL}))
    SELECT module, count(*) AS files, sum(lines)::bigint AS lines, sum(covered)::bigint AS lines_covered, sum(covered) * 100.0::double / nullif(sum(lines), 0) AS line_percent, NULL::double AS branch_percent, false AS is_total FROM m GROUP BY module
    UNION ALL SELECT 'TOTAL', count(*), sum(lines)::bigint, sum(covered)::bigint, sum(covered) * 100.0::double / nullif(sum(lines), 0), NULL, true FROM m"""
)
def coverage_summary(spark, d):
    files = cov.merge(_hits(spark, d)).withColumn("module", paths.module_of(F.col("path"), COVER_RULES))
    return cov.summary(files).select("module", "files", "lines", "lines_covered", "line_percent", "branch_percent", "is_total")


@query(
    f"""WITH m AS (SELECT CASE WHEN path LIKE '1%' THEN '/p/' || substr(path, 1, 2) ELSE '/q/' || path END AS file, lines, covered FROM ({_MERGED_SQL}))
    SELECT file, sum(lines)::bigint AS lines, sum(covered)::bigint AS lines_covered, (SELECT count(*) FROM m WHERE NOT starts_with(file, '/p/')) AS outside FROM m WHERE starts_with(file, '/p/') GROUP BY file"""
)
def attribute_outside(spark, d):
    """Paths that map to one file are added up, not merged; those outside are counted."""
    p = F.col("path")
    mapped = F.when(p.startswith("1"), F.concat(F.lit("/p/"), F.substring(p, 1, 2))).otherwise(F.concat(F.lit("/q/"), p))
    inside, outside = cov.attribute(cov.merge(_hits(spark, d)), mapped, paths.is_within(mapped, "/p"))
    return inside.select("file", "lines", "lines_covered").crossJoin(outside)  # one row


@query("SELECT '/trace/order/' || l_orderkey AS path, count(DISTINCT l_linenumber) AS lines, count(DISTINCT l_linenumber) FILTER (l_quantity::bigint % 3 > 0) AS lines_covered FROM lineitem GROUP BY l_orderkey")
def lcov_round_trip(spark, d):
    """A tracefile is written for each order's lines, then read by the line protocol."""
    l = _t(spark, d, "lineitem")  # noqa: E741
    da = F.concat(F.lit("DA:"), "l_linenumber", F.lit(","), (F.col("l_quantity").cast("bigint") % 3).cast("string"))
    t = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(da)).alias("da"))
    text = F.concat(F.lit("TN:\nSF:order/./"), F.col("l_orderkey").cast("string"), F.lit("\r\n"), F.array_join("da", "\n"), F.lit("\nLF:0\nend_of_record\n"))
    texts = t.select(F.concat(F.lit("/trace/"), F.col("l_orderkey").cast("string"), F.lit(".info")).alias("source"), text.alias("text"))
    return cov.merge(coverage_files.read_coverage(texts)[0]).select("path", "lines", "lines_covered")


# Graphs


def _edges(spark, d) -> DataFrame:
    """Nations of customers -> nations of their suppliers, distinct."""
    o, l = _t(spark, d, "orders").select("o_orderkey", "o_custkey"), _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")  # noqa: E741
    c, s = _t(spark, d, "customer").select("c_custkey", "c_nationkey"), _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = l.join(s, l.l_suppkey == s.s_suppkey).join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return graph.distinct_edges(j, "c_nationkey", "s_nationkey")


_EDGES_SQL = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(
    f"""WITH e AS ({_EDGES_SQL}) SELECT n_nationkey AS node, (SELECT count(*) FROM e WHERE dst = n_nationkey)::bigint AS fan_in, (SELECT count(*) FROM e WHERE src = n_nationkey)::bigint AS fan_out FROM nation"""
)
def fan_in_out(spark, d):
    return graph.fan(_edges(spark, d), _t(spark, d, "nation").select(F.col("n_nationkey").alias("node")))


def _groups(spark, d) -> DataFrame:
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("module"))


_GROUPED_SQL = f"SELECT src, dst, a.r_name AS sg, b.r_name AS dg FROM ({_EDGES_SQL}) JOIN nation x ON src = x.n_nationkey JOIN region a ON x.n_regionkey = a.r_regionkey JOIN nation y ON dst = y.n_nationkey JOIN region b ON y.n_regionkey = b.r_regionkey"


@query(f"SELECT sg AS from_group, dg AS to_group, count(*) AS edges FROM ({_GROUPED_SQL}) GROUP BY ALL")
def coupling(spark, d):
    return graph.coupling(graph.with_groups(_edges(spark, d), _groups(spark, d)))


@query(f"SELECT DISTINCT sg AS src, dg AS dst FROM ({_GROUPED_SQL}) WHERE sg <> dg")
def module_graph(spark, d):
    return graph.group_edges(graph.with_groups(_edges(spark, d), _groups(spark, d)))


_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(f"SELECT sg AS from_group, {', '.join(f'''count(*) FILTER (dg = '{n}') AS \"{n}\"''' for n in _NAMES)} FROM ({_GROUPED_SQL}) GROUP BY sg")
def coupling_matrix(spark, d):
    return graph.matrix(graph.coupling(graph.with_groups(_edges(spark, d), _groups(spark, d))), list(_NAMES))


_REACH_SQL = """WITH RECURSIVE e AS ({}), r(a, b) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
    m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS low FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""
_NEXT_SQL = "SELECT DISTINCT src, l_suppkey AS dst FROM (SELECT lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS src, l_suppkey FROM lineitem) WHERE src IS NOT NULL"


@query(f"{_REACH_SQL.format(_NEXT_SQL)} SELECT node, dense_rank() OVER (ORDER BY low)::int AS cycle FROM m")
def scc_cycles(spark, d):
    """A dense graph: the supplier of a line -> the supplier of the next line of its order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    e = _t(spark, d, "lineitem").select(F.lag("l_suppkey").over(w).alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.number_cycles(graph.strong_components(graph.distinct_edges(e.where("src is not null"))))


_TURNS_SQL = "SELECT DISTINCT a.conv_id || ':' || a.role AS src, b.conv_id || ':' || b.role AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


@query(f"{_REACH_SQL.format(_TURNS_SQL)} SELECT node, low AS cycle_min FROM m")
def scc_turns(spark, d):
    """A graph of many components: a role of a conversation -> the role of the next turn."""
    t = _t(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    name = lambda x: F.concat(F.col(f"{x}.conv_id").cast("string"), F.lit(":"), F.col(f"{x}.role"))
    j = t.alias("a").join(t.alias("b"), F.expr("a.conv_id = b.conv_id and b.turn = a.turn + 1"))
    return graph.strong_components(graph.distinct_edges(j.select(name("a").alias("src"), name("b").alias("dst"))))


@query("SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AS parsed FROM part")
def parsed_flag(spark, d):
    p, l = _t(spark, d, "part").select("p_partkey"), _t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("parsed", F.lit(True))  # noqa: E741
    return p.join(l, "p_partkey", "left").fillna(False, ["parsed"])


# Lines and tokens


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, count(*) AS physical, count(*) FILTER (trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '') AS blank FROM l GROUP BY doc_id)
    SELECT doc_id, coalesce(physical, 0)::bigint AS physical, coalesce(blank, 0)::bigint AS blank, 0::bigint AS comment, coalesce(physical - blank, 0)::bigint AS code FROM documents LEFT JOIN c USING (doc_id)"""
)
def loc_documents(spark, d):
    return lines.line_counts(_t(spark, d, "documents"), path="doc_id", content="text").withColumnRenamed("file", "doc_id")


def _sources(spark, d) -> DataFrame:
    """A small source file for each part, of lines whose kinds are known."""
    name = F.concat(F.lit("/* "), "p_name", F.lit(" */\n\nint v = "), F.col("p_size").cast("string"), F.lit("; // "), "p_brand", F.lit("\n#define X \\\n  1'0 /* a\n b\n*/\nchar c = '\"'; // \" /*\n"))
    return _t(spark, d, "part").select("p_partkey", F.concat(name, F.expr("repeat('  // x\n', p_size % 4)"), F.expr("if(p_size % 2 = 0, '\\t\n', 'R\"a(// no\n\n)a\"')")).alias("content"))


@query(
    """SELECT p_partkey, (8 + p_size % 4 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 3 END)::bigint AS physical, (1 + 1)::bigint AS blank, (1 + 2 + p_size % 4)::bigint AS comment,
    (4 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 2 END)::bigint AS code FROM part"""
)
def loc_synthetic(spark, d):
    return lines.line_counts(_sources(spark, d), path="p_partkey").withColumnRenamed("file", "p_partkey")


@query(
    """SELECT kind, count(*) AS lines FROM (SELECT unnest(list_concat(['comment', 'blank', 'code', 'code', 'code', 'comment', 'comment', 'code'], list_transform(range(0, p_size % 4), lambda i: 'comment'),
    CASE WHEN p_size % 2 = 0 THEN ['blank'] ELSE ['code', 'blank', 'code'] END)) AS kind FROM part) GROUP BY kind UNION ALL SELECT 'TOTAL', sum(8 + p_size % 4 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 3 END)::bigint FROM part"""
)
def line_kinds(spark, d):
    t = lines.line_table(_sources(spark, d), path="p_partkey")
    return stats.with_total(t, "kind", lambda x, k: x.groupBy(*k).agg(F.count(F.lit(1)).alias("lines"))).drop("is_total")


_WORDS = "[A-Za-z]+|[0-9]+|[.,()]"
_ROLE_SQL = "CASE WHEN t IN ('this', 'true') THEN 'operand' WHEN t IN ('for', 'if', 'or', 'and', 'not') OR t IN ('.', ',', '(') THEN 'operator' WHEN t = ')' THEN 'not_counted' ELSE 'operand' END"
_H_SQL = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORDS}')) AS t FROM documents), r AS (SELECT doc_id, t, {_ROLE_SQL} AS role FROM t UNION ALL SELECT doc_id, NULL, NULL FROM documents),
    h AS (SELECT doc_id, count(DISTINCT t) FILTER (role = 'operator') AS distinct_operators, count(DISTINCT t) FILTER (role = 'operand') AS distinct_operands,
    count(*) FILTER (role = 'operator') AS total_operators, count(*) FILTER (role = 'operand') AS total_operands FROM r GROUP BY doc_id)"""


def _token_arrays(spark, d) -> DataFrame:
    t = F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))
    kind = lambda x: F.when(x.isin("this", "true", "for", "if", "or", "and", "not"), "keyword").when(x < ":", F.when(x >= "0", "literal").otherwise("punctuation")).when(x >= "A", "identifier").otherwise("punctuation")
    docs = dealt(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.transform("t", lambda x: F.struct(kind(x).alias("kind"), x.alias("spelling"), x.alias("construct"))).alias("tokens"))


@query(f"{_H_SQL} SELECT * FROM h")
def halstead_counts(spark, d):
    return tokens.with_halstead(_token_arrays(spark, d), "tokens").select("doc_id", *tokens.COUNTS)


@query(f"{_H_SQL} SELECT * FROM h")
def halstead_of_token_table(spark, d):
    t = _token_arrays(spark, d).select("doc_id", F.explode_outer("tokens").alias("t")).select("doc_id", "t.kind", "t.spelling")
    return tokens.halstead_by(t, ["doc_id"], "kind", "spelling")


@query(
    f"""{_H_SQL}, v AS (SELECT doc_id, CASE WHEN distinct_operators + distinct_operands < 2 THEN 0 ELSE (total_operators + total_operands) * log2(distinct_operators + distinct_operands) END AS volume,
    CASE WHEN distinct_operands = 0 THEN 0 ELSE distinct_operators * total_operands / (2.0::double * distinct_operands) END AS difficulty FROM h)
    SELECT doc_id, volume::double AS volume, difficulty::double AS difficulty, (volume * difficulty)::double AS effort FROM v"""
)
def halstead_measures(spark, d):
    h = halstead_counts(spark, d)
    n1, n2, t1, t2 = (F.col(c) for c in ("distinct_operators", "distinct_operands", "total_operators", "total_operands"))
    return h.select("doc_id", measures.volume(n1, n2, t1, t2).alias("volume"), measures.difficulty(n1, n2, t2).alias("difficulty"), measures.effort(n1, n2, t1, t2).alias("effort"))


@query("SELECT doc_id, (1 + len(list_filter(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[.,()]'), lambda t: t IN ('if', 'for', 'while', 'do', 'case', 'catch'))))::int AS complexity FROM documents")
def decision_counts(spark, d):
    return _token_arrays(spark, d).select("doc_id", tokens.complexity(F.col("tokens")).alias("complexity"))


# Documentation


def _comment():
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in ("/// ", "//// ", "//! ", "/** ", "/**/ ", "/*! ", "// ", "/* ")]), (F.col("p_size") % 8 + 1).cast("int")), "p_name")


_STYLE_SQL = "CASE p_size % 8 WHEN 0 THEN 'doxygen' WHEN 2 THEN 'doxygen' WHEN 3 THEN 'doxygen' WHEN 5 THEN 'doxygen' ELSE 'plain' END"


@query(f"SELECT {_STYLE_SQL} AS style, count(*) AS entities FROM part GROUP BY 1")
def doc_style(spark, d):
    return _t(spark, d, "part").groupBy(measures.doc_style(_comment()).alias("style")).agg(F.count(F.lit(1)).alias("entities"))


@query(
    """WITH a AS (SELECT coalesce(lang, '?') AS module, quality = 1 AS documented, toxic = 1 AS doxygen FROM labels JOIN documents USING (doc_id))
    SELECT module, count(*) AS entities, count(*) FILTER (documented) AS documented, count(*) FILTER (doxygen) AS doxygen, count(*) FILTER (documented) * 100.0::double / count(*) AS percent, false AS is_total FROM a GROUP BY module
    UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (documented), count(*) FILTER (doxygen), CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (documented) * 100.0::double / count(*) END, true FROM a"""
)
def doc_coverage(spark, d):
    a = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return api_ops.doc_summary(a.select(F.coalesce("lang", F.lit("?")).alias("module"), (F.col("quality") == 1).alias("documented"), (F.col("toxic") == 1).alias("doxygen")))


# Ranges


@query(
    """WITH s AS (SELECT user_id, event_id AS b, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type FROM events WHERE event_type IN ('error', 'purchase'))
    SELECT user_id, b AS begin_id, n AS end_id FROM s WHERE event_type = 'error' AND n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = s.user_id AND c.event_type = 'click' AND c.event_id > s.b AND c.event_id < s.n)"""
)
def gap_anti_join(spark, d):
    """Errors and the user's next error or purchase, without a click strictly between."""
    from pyspark.sql import Window

    e = _t(spark, d, "events").select("user_id", "event_id", "event_type")
    s = e.where("event_type in ('error', 'purchase')").withColumn("end_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    s = s.where("event_type = 'error' and end_id is not null").select("user_id", F.col("event_id").alias("begin_id"), "end_id")
    return ranges.gap_free(s, e.where("event_type = 'click'"), ["user_id"], "begin_id", "end_id", "event_id")


_SPAN_SQL = "(SELECT o_custkey AS k, epoch(o_orderdate)::bigint AS b, epoch(o_orderdate)::bigint + 2592000 AS e FROM orders WHERE o_orderstatus = 'F')"


def _spans(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.unix_timestamp("o_orderdate").alias("at"))
    r = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("at").alias("begin_at"), (F.col("at") + 2592000).alias("end_at"))
    return o.where("o_orderstatus <> 'F'"), r


@query(f"SELECT o_orderkey, (SELECT count(*) FROM {_SPAN_SQL} WHERE k = o_custkey AND epoch(o_orderdate)::bigint >= b AND epoch(o_orderdate)::bigint < e)::bigint AS covered FROM orders WHERE o_orderstatus <> 'F'")
def interval_counts(spark, d):
    p, r = _spans(spark, d)
    return ranges.in_ranges(p, r, ["o_custkey"], "at", "begin_at", "end_at").select("o_orderkey", "covered")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM {_SPAN_SQL} WHERE k = o_custkey AND epoch(o_orderdate)::bigint > b AND epoch(o_orderdate)::bigint < e)")
def interval_anti_join(spark, d):
    p, r = _spans(spark, d)
    return api_ops.not_contained(p, r, ["o_custkey"], at="at", begin="begin_at", end="end_at").select("o_orderkey")


@query(
    f"""SELECT o_orderkey, EXISTS (SELECT 1 FROM {_SPAN_SQL} WHERE k = o_custkey AND b < epoch(o_orderdate)::bigint + 864000 AND epoch(o_orderdate)::bigint < e) AS overlaps FROM orders WHERE o_orderstatus <> 'F'"""
)
def interval_overlap(spark, d):
    p, r = _spans(spark, d)
    p = p.select("o_orderkey", "o_custkey", F.col("at").alias("begin_at"), (F.col("at") + 864000).alias("end_at"))
    return ranges.overlapping(p, r, ["o_custkey"], "begin_at", "end_at").select("o_orderkey", "overlaps")


# Texts


@query("""SELECT p_partkey, CASE WHEN regexp_matches(x, '[,"\\r\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END AS csv, replace(x, '|', '\\|') AS md, '"' || replace(replace(x, '\\', '\\\\'), '"', '\\"') || '"' AS dot
    FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || ', "x"' WHEN 1 THEN p_name || '|\\' WHEN 2 THEN p_name || chr(10) ELSE p_name END AS x FROM part)""")
def text_escapes(spark, d):
    m = F.col("p_size") % 4
    x = F.when(m == 0, F.concat("p_name", F.lit(', "x"'))).when(m == 1, F.concat("p_name", F.lit("|\\"))).when(m == 2, F.concat("p_name", F.lit("\n"))).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", measures.csv_field(F.col("x")).alias("csv"), measures.markdown_cell(F.col("x")).alias("md"), measures.dot_id(F.col("x")).alias("dot"))


# Module rows

_ROWS_SQL = f"""WITH f AS (SELECT c_mktsegment AS module, c_custkey % 5 = 0 AS t, c_acctbal > 0 AS parsed, (c_custkey % 97)::bigint AS n FROM customer UNION ALL SELECT 'tests', true, false, 7 FROM region),
    g AS (SELECT c_mktsegment AS module, c_custkey % 5 = 0 AS t, (o_orderkey % 31)::bigint AS v, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey),
    a AS (SELECT o_orderpriority AS module, o_orderstatus = 'P' AS t, o_orderstatus = 'F' AS doc FROM orders),
    h AS (SELECT r_name AS module, r_regionkey::bigint AS fan_in, 1::bigint AS fan_out, CASE WHEN r_regionkey = 0 THEN 1 END::bigint AS cycle FROM region),
    keys AS (SELECT module, false AS tot FROM f UNION SELECT module, false FROM g WHERE NOT t UNION SELECT module, false FROM a WHERE NOT t UNION SELECT module, false FROM h UNION SELECT 'TOTAL', true),
    x AS (SELECT module, tot,
      (SELECT count(*) FROM f WHERE tot OR f.module = k.module)::bigint AS files, (SELECT count(*) FILTER (parsed) FROM f WHERE tot OR f.module = k.module)::bigint AS files_parsed,
      (SELECT coalesce(sum(n) FILTER (NOT t), 0) FROM f WHERE tot OR f.module = k.module)::bigint AS production_code, (SELECT coalesce(sum(n) FILTER (t), 0) FROM f WHERE tot OR f.module = k.module)::bigint AS test_code,
      (SELECT count(*) FROM g WHERE NOT t AND (tot OR g.module = k.module))::bigint AS functions, (SELECT coalesce(median(v), 0) FROM g WHERE NOT t AND (tot OR g.module = k.module))::double AS complexity_median,
      (SELECT coalesce(quantile_disc(v, 0.9), 0) FROM g WHERE NOT t AND (tot OR g.module = k.module))::bigint AS complexity_p90, (SELECT count(*) FROM g WHERE NOT t AND v > 20 AND (tot OR g.module = k.module))::bigint AS high,
      (SELECT count(*) FROM a WHERE NOT t AND (tot OR a.module = k.module))::bigint AS api, (SELECT count(*) FROM a WHERE NOT t AND doc AND (tot OR a.module = k.module))::bigint AS documented FROM keys k)
    SELECT x.module, files, files_parsed, production_code, test_code, functions, complexity_median, complexity_p90, high, api, documented, CASE WHEN api = 0 THEN 0 ELSE documented * 100.0::double / api END::double AS documented_percent,
    CASE WHEN h.module IS NOT NULL AND files = 0 THEN NULL WHEN tot THEN (SELECT count(*) FROM customer WHERE c_custkey % 5 > 0) ELSE (SELECT count(*) FROM customer WHERE c_custkey % 5 > 0 AND c_mktsegment = x.module) END::bigint AS coverage_lines,
    h.fan_in, h.fan_out, h.cycle, tot AS is_total FROM x LEFT JOIN h ON h.module = x.module"""


@query(_ROWS_SQL)
def module_rows(spark, d):
    """Facts from customers, orders and regions; regions are known to the graph alone."""
    c = _t(spark, d, "customer")
    test = (F.col("c_custkey") % 5 == 0).alias("is_test")
    n = (F.col("c_custkey") % 97).cast("bigint")
    size = lambda x: [x.alias(k) for k in summary.LINES]
    files = c.select(F.col("c_mktsegment").alias("module"), test, (F.col("c_acctbal") > 0).alias("parsed"), *size(n))
    files = files.unionByName(_t(spark, d, "region").select(F.lit("tests").alias("module"), F.lit(True).alias("is_test"), F.lit(False).alias("parsed"), *size(F.lit(7).cast("bigint"))))
    o = _t(spark, d, "orders")
    price = F.col("o_totalprice")
    functions = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("module"), test, (F.col("o_orderkey") % 31).cast("bigint").alias("complexity"), price.alias("volume"), price.alias("effort"))
    api = o.select(F.col("o_orderpriority").alias("module"), (F.col("o_orderstatus") == "P").alias("is_test"), (F.col("o_orderstatus") == "F").alias("documented"))
    covered = c.select(F.col("c_mktsegment").alias("module"), test, *[F.lit(1).cast("bigint").alias(k) for k in cov.COLUMNS])
    known = _t(spark, d, "region").select(F.col("r_name").alias("module"), F.col("r_regionkey").cast("bigint").alias("fan_in"), F.lit(1).cast("bigint").alias("fan_out"), F.when(F.col("r_regionkey") == 0, F.lit(1)).cast("bigint").alias("cycle"))
    out = summary.module_rows(files, functions, api, covered, known)
    cols = "module files files_parsed production_code test_code functions complexity_median complexity_p90 high api documented documented_percent coverage_lines fan_in fan_out cycle is_total"
    return out.select(*cols.split())
