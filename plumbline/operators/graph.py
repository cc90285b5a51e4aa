"""Directed graphs: distinct edges, fan-in and fan-out, strongly connected components, coupling.

Components: trimming, weak components by hook-and-jump rounds, then Tarjan's algorithm within each weak component.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges of a weak component that one task may hold (about 1 GB); larger ones are split by reachability rounds.
TASK_EDGES = 5_000_000
#: A whole graph of at most so many edges goes to one task as it is.
SMALL_EDGES = 1_000_000


def _kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    spark = df.sparkSession
    _folder(spark)
    return df.checkpoint()


def _folder(spark: SparkSession) -> None:
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix=f"graph-{uuid.uuid4().hex[:6]}-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)


def distinct_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Self-edges stay."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def nodes(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    out = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return (out.union(isolated.select("node")) if isolated is not None else out).distinct()


def fan(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """node, fan_in, fan_out of distinct edges. One aggregation: each edge counts once for either end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    if isolated is not None:
        ends = ends.unionByName(isolated.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for nodes with an edge to another node."""
    e = _kept(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    count = e.count()
    mark = None
    while count:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hooked = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = hooked.groupBy("a").agg(F.min("b").alias("m"))
        jumped = hooked.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = _kept(jumped.where("a <> b").distinct())
        new = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def tarjan(pairs: list[tuple]) -> list[list]:
    """Strongly connected components of more than one node, members ascending, by an explicit stack."""
    after: dict = {}
    for s, d in pairs:
        after.setdefault(s, []).append(d)
        after.setdefault(d, [])
    index: dict = {}
    low: dict = {}
    held, stack, out = set(), [], []
    for root in sorted(after):
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    held.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in held:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    found = []
                    while True:
                        x = stack.pop()
                        held.discard(x)
                        found.append(x)
                        if x == node:
                            break
                    if len(found) > 1:
                        out.append(sorted(found))
    return out


def _together(batches: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
    """The batches of a task as one, if there are any; for inputs of a checked size."""
    kept = [b for b in batches if len(b)]
    return [pd.concat(kept)] if kept else []


def _trim(e: DataFrame, rounds: int) -> DataFrame:
    """Without edges at nodes that nothing enters or nothing leaves: those are in no cycle."""
    for _ in range(rounds):
        e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    return e


def _reach(e: DataFrame, seeds: DataFrame, forward: bool) -> DataFrame:
    """Nodes that can be reached from the seeds, in rounds."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    seen, new = _kept(seeds.select("node")), _kept(seeds.select("node"))
    while True:
        new = _kept(e.join(new, e[a] == new["node"], "left_semi").select(F.col(b).alias("node")).distinct().join(seen, "node", "left_anti"))
        if not new.count():
            return seen
        seen = _kept(seen.union(new))


def strong_components(edges: DataFrame, trim_rounds: int = 2, task_edges: int = TASK_EDGES, small_edges: int = SMALL_EDGES) -> DataFrame:
    """node, cycle_min: the nodes of components of more than one node, and each component's smallest."""
    e = _kept(distinct_edges(edges).where("src <> dst"))
    kind = dict(e.dtypes)["src"]
    out = None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = tarjan(list(zip(pdf["src"], pdf["dst"], strict=True)))
        return pd.DataFrame([(x, c[0]) for c in found for x in c], columns=["node", "cycle_min"])

    if e.count() <= small_edges:
        return e.coalesce(1).mapInPandas(lambda batches: (run(x) for x in _together(batches)), f"node {kind}, cycle_min {kind}")
    e = _kept(_trim(e, trim_rounds))
    while True:
        if not e.count():
            small = e.select(F.col("src").alias("node"), F.col("src").alias("cycle_min"))
            return small if out is None else out
        wcc = weak_components(e)
        e = _kept(e.join(wcc.withColumnRenamed("node", "src"), "src"))
        sizes = e.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        large = _kept(sizes.where(F.col("n") > task_edges).select("component"))
        fits = e.join(large, "component", "left_anti") if large.count() else e
        small = fits.groupBy("component").applyInPandas(run, f"node {kind}, cycle_min {kind}")
        out = small if out is None else out.union(small)
        if not large.count():
            return out
        # of a large one: the component of its node of most edges, by reaching forward and back; the rest goes on
        rest = e.join(large, "component").select("component", "src", "dst")
        ends = rest.select("component", F.col("src").alias("node")).union(rest.select("component", F.col("dst").alias("node")))
        hub = ends.groupBy("component", "node").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max(F.struct("n", "node")).alias("h")).select(F.col("h.node").alias("node"), "component")
        hub = _kept(hub)
        both = _kept(_reach(rest, hub, True).join(_reach(rest, hub, False), "node"))
        named = both.join(wcc, "node")
        low = named.groupBy("component").agg(F.min("node").alias("cycle_min"), F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.union(named.join(low, "component").select("node", "cycle_min"))
        e = rest.join(both, rest.src == both.node, "left_anti")
        e = _kept(_trim(e.join(both, e.dst == both.node, "left_anti").select("src", "dst"), trim_rounds))


def number_cycles(members: DataFrame) -> DataFrame:
    """node, cycle: cycles numbered from 1 in the order of their smallest members, which are ranked range by range."""
    ranges = _kept(members.select("cycle_min").distinct().repartitionByRange("cycle_min").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("cycle_min"))
    numbers = ranges.join(F.broadcast(start), "_range").select("cycle_min", (F.col("_start") + rank).cast("int").alias("cycle"))
    return members.join(numbers, "cycle_min").select("node", "cycle")


def cycles(numbered: DataFrame) -> DataFrame:
    """cycle, size, members (ascending)."""
    return numbered.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("node")).alias("members"))


def with_groups(edges: DataFrame, groups: DataFrame, group: str = "module") -> DataFrame:
    """src, dst, src_group, dst_group; groups has node and group."""
    a = groups.select(F.col("node").alias("src"), F.col(group).alias("src_group"))
    b = groups.select(F.col("node").alias("dst"), F.col(group).alias("dst_group"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "src_group", "dst_group")


def coupling(grouped: DataFrame) -> DataFrame:
    """Distinct edges for each pair of groups, pairs of one group with itself too."""
    return grouped.groupBy(F.col("src_group").alias("from_group"), F.col("dst_group").alias("to_group")).agg(F.count(F.lit(1)).alias("edges"))


def group_edges(grouped: DataFrame) -> DataFrame:
    """Distinct edges between different groups."""
    return grouped.where("src_group <> dst_group").select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst")).distinct()


def matrix(pairs: DataFrame, names: list, row: str = "from_group", col: str = "to_group", value: str = "edges") -> DataFrame:
    """The coupling matrix: a row and a column for each name, 0 where there is no edge. names is small (it is shown)."""
    return pairs.groupBy(row).pivot(col, names).agg(F.sum(value)).fillna(0)


def dot(edges: list[tuple[str, str]], groups: dict[str, str], cycle_of: dict[str, int], unassigned: str = "(unassigned)") -> str:
    """Graphviz text: a cluster for each named group, edges within a cycle coloured."""
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = ["digraph includes {", "  rankdir=LR;", "  node [shape=box];"]
    for n, g in enumerate(sorted(set(groups.values()))):
        inside = [q(x) for x in sorted(groups) if groups[x] == g]
        if g == unassigned:
            lines += [f"  {x};" for x in inside]
        else:
            lines += [f"  subgraph cluster_{n} {{", f"    label={q(g)};", *[f"    {x};" for x in inside], "  }"]
    for a, b in sorted(edges):
        ring = a != b and a in cycle_of and cycle_of.get(a) == cycle_of.get(b)
        lines.append(f"  {q(a)} -> {q(b)}{' [color=red]' if ring else ''};")
    return "\n".join([*lines, "}"]) + "\n"

