"""Dependency graphs: degrees, hot spots, reachability, subgraphs, cycles."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder the session names; only a local session may name none."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return df.checkpoint()


def spread(df: DataFrame, *key: str, rows: int = 500_000, count: int | None = None) -> DataFrame:
    """Rows dealt by the key into partitions of some ``rows`` each, so that a task's memory does not grow with the input.
    They are counted first, unless ``count`` says how many there may be."""
    n = df.count() if count is None else count
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows)), *key)


def met(df: DataFrame) -> DataFrame:
    """A side of a join by sorted rows: in loops over many rounds nothing is gathered in the driver to be broadcast."""
    return df.hint("merge")


def build(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules source, has_circular; edges src, dst, type, circular) from rows (src, dst, type, circular, ord)."""
    edges = raw.select("src", "dst", "type", F.coalesce("circular", F.lit(False)).alias("circular"), "ord")
    ends = edges.filter("circular").select(F.explode(F.array("src", "dst")).alias("source")).distinct().withColumn("c", F.lit(True))
    sources = edges.groupBy(F.col("src").alias("source")).agg(F.min("ord").alias("ord"))
    local = edges.filter("type = 'local'").groupBy(F.col("dst").alias("source")).agg(F.min("ord").alias("ord"))
    modules = sources.unionAll(local).groupBy("source").agg(F.min("ord").alias("ord")).join(ends, "source", "left")
    return modules.select("source", F.coalesce("c", F.lit(False)).alias("has_circular"), "ord"), edges


def dependents(edges: DataFrame) -> DataFrame:
    """In-degree with multiplicity."""
    return edges.groupBy(F.col("dst").alias("source")).agg(F.count(F.lit(1)).alias("n_dependents"))


def out_degree(edges: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(source, n_dependencies); with modules (source) also those without any, as 0."""
    out = edges.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n_dependencies"))
    return out if modules is None else modules.select("source").distinct().join(out, "source", "left").na.fill(0, ["n_dependencies"])


def top(counts: DataFrame, n: str, k: int = 10, tie: str = "source") -> DataFrame:
    """The k largest; TakeOrderedAndProject, no full sort."""
    return counts.orderBy(F.desc(n), tie).limit(k)


def affected(seeds: DataFrame, edges: DataFrame, every: int = 4, most: int | None = None) -> DataFrame:
    """(node, depth): all that reach a seed along dependencies, seeds at depth 0; cycles end by the anti join.

    seeds: node.  Edges are written once, dealt by what they lead to, so that a round shuffles its
    frontier alone; the visited set is cut from its lineage every few rounds.
    """
    back = durable(edges.select(F.col("dst").alias("node"), "src").repartition("node"))
    seen = durable(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = met(frontier.select("node")).join(back, "node").select(F.col("src").alias("node")).distinct()
        frontier = durable(step.join(met(seen.select("node")), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
        if depth % every == 0:
            seen = durable(seen)
    return seen


def affected_with_reason(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """changes: path, status (the smallest counts where a path has several).  (path, reason, depth)."""
    got = affected(changes.select(F.col("path").alias("node")), edges)
    out = got.join(changes.groupBy("path").agg(F.min("status").alias("status")), F.col("node") == F.col("path"), "left")
    return out.select(F.col("node").alias("path"), F.when(F.col("status").isNotNull(), F.concat(F.lit("Directly "), "status")).otherwise("Depends on changed file").alias("reason"), "depth")


def affected_folders(got: DataFrame, folder: Column) -> DataFrame:
    """got: path, reason, depth.  (folder, n_files, reason): the reason of a folder's first file by depth, then path."""
    return got.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.min_by("reason", F.struct("depth", "path")).alias("reason"))


def analysis_scope(all_folders: DataFrame, hit: DataFrame) -> DataFrame:
    """all_folders, hit: folder.  One row: total, affected, unaffected, reduction (percent)."""
    n = all_folders.select("folder").distinct().join(hit.select("folder").distinct().withColumn("h", F.lit(1)), "folder", "full")
    out = n.join(all_folders.select("folder").distinct().withColumn("a", F.lit(1)), "folder", "left").agg(F.count("a").alias("total"), F.count("h").alias("affected"), F.count_if(F.col("a").isNotNull() & F.col("h").isNull()).alias("unaffected"))
    return out.withColumn("reduction", F.when(F.col("total") > 0, F.round((1 - F.col("affected") / F.col("total")) * 100)).otherwise(0).cast("long"))


def violation_cycles(violations: DataFrame) -> DataFrame:
    """violations: rule, from, to, cycle (array, may be null), severity.  (path, severity) of those of cycles between two files."""
    rows = violations.filter("rule = 'no-circular' and from <> '' and to <> '' and from <> to")
    return rows.select(F.when(F.size("cycle") > 0, F.col("cycle")).otherwise(F.array("from", "to", "from")).alias("path"), F.coalesce("severity", F.lit("error")).alias("severity"))


def cycles(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, cycle): nodes on cycles with the smallest node that they and it reach each other, by colours.

    Nodes without a way in or out go first, over and over.  Then every node takes the smallest node
    that reaches it as its colour; those of a colour that reach its namesake are one cycle and go;
    until nothing is left (Orzan, 2004).  Loops of a node to itself are no cycles.
    """
    e = durable(edges.select("src", "dst").filter("src <> dst").distinct())
    out = None
    for _ in range(rounds):
        while True:  # what cannot be on a cycle
            n = e.count()
            e = durable(e.join(met(e.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(met(e.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"))
            if e.count() == n:
                break
        if n == 0:
            break
        colour = durable(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            into = e.join(met(colour), F.col("src") == F.col("node")).groupBy("dst").agg(F.min("c").alias("m"))
            new = durable(colour.join(met(into), F.col("node") == F.col("dst"), "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            colour = new.select("node", "c")
            if new.filter("moved").isEmpty():
                break
        same = durable(e.join(met(colour.withColumnRenamed("node", "src")), "src").join(met(colour.select(F.col("node").alias("dst"), F.col("c").alias("d"))), "dst").filter("c = d").select("src", "dst", "c"))
        roots = colour.filter("node = c").select("node")
        found = durable(affected(roots, same.select("src", "dst")).select("node").join(met(colour), "node"))
        out = found if out is None else out.unionAll(found)
        e = durable(e.join(met(found.select(F.col("node").alias("src"))), "src", "left_anti").join(met(found.select(F.col("node").alias("dst"))), "dst", "left_anti").select("src", "dst"))
    else:
        raise RuntimeError("cycles did not settle")
    empty = edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)
    if out is None:
        return empty
    out = out.select("node", F.col("c").alias("cycle"))
    size = out.groupBy("cycle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out.join(met(size.select("cycle")), "cycle", "left_semi").select("node", "cycle")


def cycle_paths(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(cycle, place, node): of each set of nodes that reach each other, a shortest circle through its smallest
    node, from that node (place 0) back to it.  members: node, cycle (``cycles`` of the edges, if not given).

    All sets walk at once, a layer a round; a node keeps the smallest node that it was met from, and
    a set stops when it comes back, from the smallest such node.
    """
    members = durable(cycles(edges) if members is None else members.select("node", "cycle"))
    of = lambda c: members.select(F.col("node").alias(c), F.col("cycle").alias(f"_{c}"))
    inner = edges.select("src", "dst").filter("src <> dst").distinct().join(met(of("src")), "src").join(met(of("dst")), "dst").filter("_src = _dst")
    inner = durable(inner.select(F.col("_src").alias("cycle"), "src", "dst"))
    roots = members.filter("node = cycle").select("cycle", "node")
    seen = frontier = durable(roots.select("cycle", "node", F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.lit(0).alias("depth")))
    ends, depth = None, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.select("cycle", F.col("node").alias("src")).join(met(inner), ["cycle", "src"]).groupBy("cycle", F.col("dst").alias("node")).agg(F.min("src").alias("parent")).withColumn("depth", F.lit(depth))
        step = durable(step)
        back = step.filter("node = cycle")
        ends = back if ends is None else ends.unionByName(back)
        frontier = durable(step.join(met(back.select("cycle")), "cycle", "left_anti").join(met(seen.select("cycle", "node")), ["cycle", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    if ends is None:
        return members.select("cycle", F.lit(0).alias("place"), "node").limit(0)
    at = durable(ends.select("cycle", "node", "parent", F.col("depth").alias("place")))
    out = at
    while True:
        at = at.filter("place > 0").select("cycle", F.col("parent").alias("node"), (F.col("place") - 1).alias("place")).join(met(seen.select("cycle", "node", "parent")), ["cycle", "node"])
        at = durable(at.select("cycle", "node", "parent", "place"))
        if at.isEmpty():
            return out.select("cycle", "place", "node")
        out = out.unionByName(at)


def reach_two(seeds: DataFrame, edges: DataFrame, barred: DataFrame) -> DataFrame:
    """(node, seed): reached from a seed by one or two dependencies, never through barred nodes."""
    e = edges.select("src", "dst").distinct().join(barred.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    one = seeds.select(F.col("node").alias("seed")).join(e, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"))
    two = one.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))
    return one.unionAll(two).filter("seed <> node").distinct()


def hubs(reached: DataFrame, least: int = 3) -> DataFrame:
    return reached.groupBy("node").agg(F.count_distinct("seed").alias("n_seeds")).filter(F.col("n_seeds") >= least)


def mutual(edges: DataFrame) -> DataFrame:
    """(a, b): pairs that depend on each other directly."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"]).filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def subgraph(edges: DataFrame, inside: Column) -> DataFrame:
    """(kind, node): inside nodes, what they depend on outside, and what depends on them from outside.

    ``inside`` is a function of a column name's value, given as an expression on ``node``.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("inside", inside)
    within = nodes.filter("inside").select("node")
    s, d = within.select(F.col("node").alias("src")), within.select(F.col("node").alias("dst"))
    deps = edges.join(s, "src", "left_semi").join(d, "dst", "left_anti").select(F.lit("external_dependency").alias("kind"), F.col("dst").alias("node"))
    used = edges.join(d, "dst", "left_semi").join(s, "src", "left_anti").select(F.lit("external_dependent").alias("kind"), F.col("src").alias("node"))
    return within.select(F.lit("internal").alias("kind"), "node").unionAll(deps).unionAll(used).distinct()


def best_prefix(nodes: DataFrame, segment: str) -> DataFrame:
    """The commonest path beginning that ends in ``segment`` (ties: the smaller)."""
    p = F.regexp_extract("node", rf"^((?:.*/)?{re.escape(segment)})/", 1)
    return nodes.select(p.alias("prefix")).filter("prefix <> ''").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(1)


def folder_graph(edges: DataFrame, folder: str) -> DataFrame:
    """edges: src, dst (paths).  (kind, node) of a folder: files below it, or if there are none those below any
    folder of its last segment; outside is what does not begin like the commonest of these."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    base = folder.rstrip("/")
    inside, prefix = F.col("node").startswith(f"{base}/") | (F.col("node") == folder), f"{base}/"
    if nodes.filter(inside).isEmpty():
        last = base.split("/")[-1]
        best = best_prefix(nodes, last).first()
        inside = F.col("node").startswith(f"{last}/") | F.col("node").contains(f"/{last}/")
        prefix = f"{best['prefix']}/" if best else prefix
    within = nodes.filter(inside).select("node")
    outer = lambda c: ~F.col(c).startswith(prefix) & (F.col(c) != folder)
    deps = edges.filter(outer("dst")).join(within, F.col("src") == F.col("node"), "left_semi").select(F.lit("external_dependency").alias("kind"), F.col("dst").alias("node"))
    used = edges.filter(outer("src")).join(within, F.col("dst") == F.col("node"), "left_semi").select(F.lit("external_dependent").alias("kind"), F.col("src").alias("node"))
    return within.select(F.lit("internal").alias("kind"), "node").unionAll(deps).unionAll(used).distinct()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of the weakly connected component.

    Two steps in turn, until no edge changes: every node links its larger neighbours, then its smaller
    ones, with the smallest of all (large-star and small-star; Kiveris et al., 2014).  Edges never grow in
    number, and a giant component ends as a star of its smallest node, whose neighbours are only ever
    aggregated to a minimum in part before they meet; the joins on a hub are split by the runtime.
    """
    kind = nodes.schema["node"].dataType

    def pairs(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, e = None, durable(pairs(edges.select(F.col("src").cast(kind).alias("a"), F.col("dst").cast(kind).alias("b"))))
    for _ in range(rounds):
        both = e.unionAll(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = pairs(both.filter("b > a").join(met(least), "a").select("b", "m").toDF("a", "b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(met(least), "a").select("b", "m").unionAll(least.select("a", "m"))
        e = durable(pairs(small.toDF("a", "b")))
        before, now = now, e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(e.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def mermaid(edges: DataFrame, n: int = 50) -> str:
    """A graph of the first n local edges visited, each once."""
    rows = edges.filter("type = 'local'").orderBy("ord").limit(n).groupBy("src", "dst").agg(F.min("ord").alias("ord")).orderBy("ord").collect()
    clean = lambda x: re.sub("^_|_$", "", re.sub("_+", "_", re.sub("[^a-zA-Z0-9_-]", "_", x)))
    return "\n".join(["graph TD", *[f'  {clean(r["src"])}["{r["src"]}"] --> {clean(r["dst"])}["{r["dst"]}"]' for r in rows]])


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
