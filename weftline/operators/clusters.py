"""Clusters of files around seeds: greedy claims, orphans, overlaps, splits and names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.code import cluster_thresholds
from weftline.functions.paths import ancestors, common_directory, dirname, path_id, stem
from weftline.operators.graph import components, durable, hubs, met, reach_two, spread
from weftline.operators.tasks import ranked

FALLBACK_TOKENS = 1000
OVERLAP = 0.3
MAJORITY = 0.3
# What labels of clusters end in.
LABELS = {"component": " 组件簇", "module": " 模块", "orphan": " 工具"}


def claims(wants: DataFrame, least: int, first: list) -> DataFrame:
    """wants: seed, path, via, way (0 itself, 1 a dependency, 2 a dependency of ``via``, 3 a dependent), tokens, k (place
    of the seed).  (cluster, path, tokens): what seeds get that claim one after the other, in rounds.

    A seed is settled once no earlier unsettled seed wants a path that it wants: seeds of one round
    share no path, so that none of them could change what another gets.  What they take goes from
    the wants of the rest, and a seed that is taken goes as a whole, so that a path wanted by many
    is in the way of others for one claim only.
    """
    left, out = durable(wants), None
    while not left.isEmpty():
        earliest = left.groupBy("path").agg(F.min("k").alias("_f"))
        late = left.join(earliest, "path").filter("_f < k").select("seed", F.lit(True).alias("_late")).distinct()
        now = durable(left.join(late, "seed", "left"))
        ready, left = now.filter("_late is null").drop("_late"), now.filter("_late").drop("_late")
        near = ready.filter("way < 2").select("seed", F.col("path").alias("via")).distinct()
        own = ready.filter("way <> 2").unionByName(ready.filter("way = 2").join(near, ["seed", "via"], "left_semi")).select("seed", "path", "tokens").distinct()
        enough = own.groupBy("seed").agg(F.sum("tokens").alias("_t")).filter((F.col("_t") >= least) | F.col("seed").isin(first))
        got = durable(own.join(enough, "seed", "left_semi"))
        taken = got.select("path").distinct()
        gone = left.filter("way = 0").join(taken, "path", "left_semi").select("seed")
        left = durable(left.join(taken, "path", "left_anti").join(gone, "seed", "left_anti"))
        out = got if out is None else out.unionAll(got)
    empty = wants.select("seed", "path", "tokens").limit(0)
    return (empty if out is None else out).withColumnRenamed("seed", "cluster")


def greedy(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files: path, tokens, is_seed, is_barrel; edges: src, dst.  (cluster, path, tokens): claims of seeds.

    Seeds in order of tokens (ties by path) claim what they reach in two steps, unless it is a hub,
    a barrel or claimed, and their direct dependents (see ``claims``).  Clusters below the least size
    go, but not the largest seed's.  Files without a size count ``FALLBACK_TOKENS``.
    """
    known = F.coalesce("tokens", F.lit(FALLBACK_TOKENS)).cast("long")
    size = durable(files.select("path", known.alias("tokens"), "is_seed", "is_barrel"))
    total = size.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    least = total.select(cluster_thresholds(F.col("t"))["min_tokens"].alias("m")).first()["m"]
    seeds = size.filter("is_seed").select(F.col("path").alias("node"))
    barrels = size.filter("is_barrel").select(F.col("path").alias("node"))
    closed = durable(hub_files(size, edges).unionAll(barrels).distinct())  # may be seeds, but are never claimed
    first = [r["path"] for r in size.filter("is_seed").orderBy(F.desc("tokens"), "path").limit(1).select("path").collect()]
    # what a seed may claim: a dependency, a dependency of one (``via``), a dependent
    open_ = edges.select("src", "dst").distinct().join(closed.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    one = seeds.join(open_, F.col("node") == F.col("src")).select(F.col("node").alias("seed"), F.col("dst").alias("path"))
    two = one.withColumnRenamed("path", "via").join(open_, F.col("via") == F.col("src")).select("seed", F.col("dst").alias("path"), "via")
    uses = edges.join(seeds, F.col("dst") == F.col("node")).join(closed.select(F.col("node").alias("src")), "src", "left_anti").select(F.col("dst").alias("seed"), F.col("src").alias("path"))
    seed, way = F.col("seed"), lambda n: F.lit(n).alias("way")
    wanted = (
        seeds.select(F.col("node").alias("seed"), F.col("node").alias("path"), F.col("node").alias("via"), way(0))
        .unionAll(one.select("seed", "path", seed.alias("via"), way(1))).unionAll(two.select("seed", "path", "via", way(2))).unionAll(uses.select("seed", "path", seed.alias("via"), way(3))).distinct()
    )
    place = size.select(F.col("path").alias("seed"), F.struct((-F.col("tokens")).alias("t"), F.col("path").alias("p")).alias("k"))
    return claims(wanted.join(size.select("path", "tokens"), "path").join(place, "seed"), least, first)


def hub_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files: path, is_seed, is_barrel.  (node): reached by three seeds or more."""
    named = lambda flag: files.filter(flag).select(F.col("path").alias("node"))
    return hubs(reach_two(named("is_seed"), edges, named("is_barrel"))).select("node")


def shared(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, path, tokens): hubs that are known files and no barrels, as one cluster ``shared-utilities``."""
    rows = files.filter(~F.col("is_barrel")).join(hub_files(files, edges), F.col("path") == F.col("node"), "left_semi")
    return rows.select(F.lit("shared-utilities").alias("cluster"), "path", F.coalesce("tokens", F.lit(FALLBACK_TOKENS)).cast("long").alias("tokens"))


#: Parts that files are dealt into for ``overlapping``, and pairs that a task counts at a time.
PARTS, PAIRS = 32, 2_000_000


def _met_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (c, path, n: files of c) of a part: the pairs of clusters that may overlap; with the files that they share
    here, where the least number is so small that every shared file counts, else null."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    cluster, path = (table.column(c).combine_chunks().dictionary_encode() for c in ("c", "path"))
    c, p = (x.indices.to_numpy(zero_copy_only=False).astype("i8") for x in (cluster, path))
    size = np.zeros(len(cluster.dictionary), "i8")
    size[c] = table.column("n").to_numpy()
    del table, got
    order = np.lexsort((c, p))
    c, p = c[order], p[order]
    m = np.searchsorted(p, p, "right") - np.arange(len(p)) - 1  # rows behind, of the same file and later clusters
    rows = np.argsort(c, kind="stable")
    rows = rows[m[rows] > 0]
    upto, firsts = np.cumsum(m[rows]), np.flatnonzero(np.diff(c[rows], prepend=-1))
    at = 0
    while at < len(rows):  # whole clusters, of some ``PAIRS`` pairs
        done = int(upto[at - 1]) if at else 0
        k = int(np.searchsorted(firsts, max(at + 1, np.searchsorted(upto, done + PAIRS, "right"))))
        stop = int(firsts[k]) if k < len(firsts) else len(rows)
        own = rows[at:stop]
        n = m[own]
        other = c[np.repeat(own + 1 - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        pairs, shared = np.unique(np.repeat(c[own], n) * len(size) + other, return_counts=True)
        x, y = pairs // len(size), pairs % len(size)
        least = np.floor(OVERLAP * np.minimum(size[x], size[y])).astype("i8")
        keep = shared * PARTS >= least
        told = pa.array(shared[keep].astype("i8"), mask=least[keep] > PARTS)
        yield pa.RecordBatch.from_arrays([cluster.dictionary.take(pa.array(x[keep])), cluster.dictionary.take(pa.array(y[keep])), told], names=["x", "y", "shared"])
        at = stop


def overlapping(held: DataFrame, size: DataFrame) -> DataFrame:
    """held: c, path (once each); size: c, size.  (a, b, shared): pairs that share at least ``OVERLAP`` of the smaller one.

    Files are dealt into ``PARTS`` parts.  Of t files that a pair shares some part holds t / ``PARTS`` or
    more, so that a part tells only the pairs that share as many in it; these few are counted by a
    join.  Pairs for which one file would be enough are told with their counts, which are added up.
    """
    kind = held.schema["c"].dataType.simpleString()
    told = held.filter("path is not null").join(met(size.select("c", F.col("size").alias("n"))), "c").select("c", "path", "n").repartition(PARTS, "path").mapInArrow(_met_in_part, f"x {kind}, y {kind}, shared long")
    told = durable(told.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared"))
    added = spread(told.filter("shared is not null"), "a", "b").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    few = spread(told.filter("shared is null").select("a", "b"), "a", "b").distinct()
    few = few.join(size.select(F.col("c").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("size").alias("nb")), "b")
    less = F.col("na") <= F.col("nb")
    few = few.select("a", "b", F.when(less, F.col("a")).otherwise(F.col("b")).alias("c"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("d"))
    both = few.join(held, "c").select("a", "b", F.col("d").alias("c"), "path").join(held, ["c", "path"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = added.unionByName(both).join(size.select(F.col("c").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("size").alias("nb")), "b")
    return out.filter(_enough(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b", "shared", "na", "nb")


def overlaps(cluster_files: DataFrame) -> DataFrame:
    """(a, b, shared, ratio): pairs that share at least ``OVERLAP`` of the smaller one (see ``overlapping``)."""
    held = durable(spread(cluster_files.select(F.col("cluster").alias("c"), "path"), "c", "path").distinct())
    size = durable(held.groupBy("c").agg(F.count(F.lit(1)).alias("size")))
    return overlapping(held, size).select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("ratio"))


def _common(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b, shared): files that two clusters (c, path) share, a before b."""
    both = x.select(F.col("c").alias("_x"), "path").join(y.select(F.col("c").alias("_y"), "path"), "path").filter("_x <> _y")
    return both.groupBy(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).agg(F.count_distinct("path").alias("shared"))


def _enough(n: Column, x: Column, y: Column) -> Column:
    return n / F.least(x, y) >= OVERLAP


def merged(cluster_files: DataFrame) -> DataFrame:
    """cluster_files: cluster, path, ord (of the cluster).  (cluster, path, parts): overlapping clusters joined.

    Of all pairs that overlap, the first by the order of clusters is joined, the later cluster to the
    earlier one, then overlaps are looked at anew, until there are none.  ``parts`` counts the clusters joined.

    Clusters that share no file, even through others, never meet, so that every component joins its
    own first pair (i, j) in the same round.  With it goes all that i would take next: clusters behind
    i, not larger than i and j together, that overlap with what is gathered.  Such a cluster's overlap
    never falls as more is gathered, so that their order does not matter, unless an earlier or a larger
    cluster could overlap on the way; then the pair alone is joined.  Counts of overlapping
    pairs are kept, and only those of joined clusters are made anew.
    """
    rows = durable(spread(cluster_files.select("cluster", "path", "ord"), "ord", "path").distinct())
    roots = rows.select(F.col("ord").alias("member"), F.col("ord").alias("root")).distinct()
    held = rows.select(F.col("ord").alias("c"), "path").distinct()
    size = durable(held.groupBy("c").agg(F.count(F.lit(1)).alias("size")))
    share = durable(overlapping(held, size).select("a", "b", "shared"))  # others matter only once one of them is joined
    group: DataFrame | None = None
    of = lambda name, size_name: size.select(F.col("c").alias(name), F.col("size").alias(size_name))
    while True:
        pairs = durable(share.join(of("a", "na"), "a").join(of("b", "nb"), "b").filter(_enough(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b"))
        if pairs.isEmpty():
            break
        if group is None:  # only components with a pair take part
            least = rows.groupBy("path").agg(F.min("ord").alias("dst"))
            star = rows.join(least, "path").select(F.col("ord").alias("src"), "dst").filter("src <> dst").distinct()
            group = durable(components(size.select(F.col("c").alias("node")), star).select(F.col("node").alias("c"), F.col("component").alias("g")))
            live = group.join(pairs.select(F.col("a").alias("c")).join(group, "c").select("g").distinct(), "g", "left_semi")
            held, size = durable(held.join(live, "c", "left_semi")), durable(size.join(live, "c", "left_semi"))
        first = durable(pairs.join(group.withColumnRenamed("c", "a"), "a").groupBy("g").agg(F.min(F.struct("a", "b")).alias("x")).select("g", F.col("x.a").alias("i"), F.col("x.b").alias("j")))
        two = first.select("g", "i", F.explode(F.array("i", "j")).alias("c"))
        taken, base = durable(two), None
        while True:
            files = held.join(taken, "c").select("g", "i", "path").distinct()
            count = durable(files.groupBy("g").agg(F.count(F.lit(1)).alias("all")))
            base = count.withColumnRenamed("all", "base") if base is None else base
            near = files.join(held, "path").groupBy("g", "i", "c").agg(F.count(F.lit(1)).alias("n")).join(taken, ["g", "c"], "left_anti")
            near = durable(near.join(size, "c").join(count, "g").join(base, "g"))
            more = near.filter((F.col("c") > F.col("i")) & (F.col("size") <= F.col("base")) & _enough(F.col("n"), F.col("all"), F.col("size"))).select("g", "i", "c")
            if more.isEmpty():
                break
            taken = durable(taken.unionByName(more))
        danger = ((F.col("c") < F.col("i")) | (F.col("size") > F.col("base"))) & _enough(F.col("n"), F.col("base"), F.col("size"))
        unsafe = near.filter(danger).select("g").distinct()
        move = durable(taken.join(unsafe, "g", "left_anti").unionByName(two.join(unsafe, "g", "left_semi")).select("c", "i"))
        held = durable(held.join(move, "c", "left").select(F.coalesce("i", "c").alias("c"), "path").distinct())
        roots = durable(roots.join(move, F.col("root") == F.col("c"), "left").select("member", F.coalesce("i", "root").alias("root")))
        changed = held.join(move.select(F.col("i").alias("c")).distinct(), "c", "left_semi")
        size = durable(size.join(move, "c", "left_anti").unionByName(changed.groupBy("c").agg(F.count(F.lit(1)).alias("size"))))
        kept = share.join(move.select(F.col("c").alias("a")), "a", "left_anti").join(move.select(F.col("c").alias("b")), "b", "left_anti")
        share = durable(kept.unionByName(_common(changed, held)))
    name = rows.select("ord", F.col("cluster").alias("_name")).distinct()
    parts = roots.groupBy("root").agg(F.count(F.lit(1)).alias("parts")).join(name, F.col("root") == F.col("ord")).select("root", F.col("_name").alias("cluster"), "parts")
    return rows.select("path", "ord").join(roots, F.col("ord") == F.col("member")).select("root", "path").distinct().join(parts, "root").select("cluster", "path", "parts")


def orphans(left: DataFrame, cluster_files: DataFrame, least: int) -> DataFrame:
    """left: path, tokens, ord (files in no cluster); cluster_files: cluster, path, ord (of the cluster).

    (path, cluster): the files of a directory, directories as met, go to the cluster with most
    directories equal to, above or below theirs (the first of equals) if they have fewer tokens than
    ``least``, else or without such a cluster to one of their own, ``orphan:`` and the directory.
    What a directory joins counts for later ones.

    Directories are decided in rounds: one waits only for earlier ones above or below it, so that
    there are no more rounds than about twice the depth of the tree.  Votes (directory, cluster)
    are counted once for the given clusters; each decision adds one for those that waited for it.
    """
    d = F.when(dirname(F.col("path")) == "", ".").otherwise(dirname(F.col("path")))
    rows = left.select("path", F.col("tokens").cast("long").alias("tokens"), F.col("ord").cast("long").alias("ord"), d.alias("dir"))
    dirs = durable(rows.groupBy("dir").agg(F.sum("tokens").alias("tokens"), F.min("ord").alias("ord")))
    held = durable(cluster_files.select(F.col("cluster").cast("string").alias("cluster"), F.col("ord").cast("long").alias("ord"), d.alias("own")).distinct())
    o, above = dirs.select("dir"), lambda c: F.explode(ancestors(F.col(c)))
    meets = held.select("cluster", "ord", "own", F.explode(F.array_union(F.array("own"), ancestors(F.col("own")))).alias("dir")).join(o, "dir").select("dir", "cluster", "ord", "own")
    meets = meets.unionByName(o.select("dir", above("dir").alias("own")).join(held, "own").select("dir", "cluster", "ord", "own")).distinct()
    votes = durable(meets.groupBy("dir", "cluster", F.struct(F.lit(0).alias("k"), F.col("ord").alias("o"), F.lit("").alias("d")).alias("place")).agg(F.count(F.lit(1)).alias("n")))
    up = dirs.select("dir", F.col("ord").alias("o"), above("dir").alias("up")).join(dirs.select(F.col("dir").alias("up"), F.col("ord").alias("p")), "up")
    later = F.struct("p", "up") < F.struct("o", "dir")
    waits = durable(up.select(F.when(later, F.col("dir")).otherwise(F.col("up")).alias("dir"), F.when(later, F.col("up")).otherwise(F.col("dir")).alias("on")))
    todo, open_, out = dirs, waits, None
    while not todo.isEmpty():
        ready = todo.join(open_.select("dir").distinct(), "dir", "left_anti")
        best = votes.join(ready.select("dir"), "dir", "left_semi").groupBy("dir", "cluster", "place").agg(F.sum("n").alias("n"))
        best = best.groupBy("dir").agg(F.min_by(F.struct("cluster", "place"), F.struct((-F.col("n")).alias("n"), "place")).alias("b"))
        joins = (F.col("tokens") < least) & F.col("b").isNotNull()
        own = F.struct(F.concat(F.lit("orphan:"), "dir").alias("cluster"), F.struct(F.lit(1).alias("k"), F.col("ord").alias("o"), F.col("dir").alias("d")).alias("place"))
        got = durable(ready.join(best, "dir", "left").select("dir", F.when(joins, F.col("b")).otherwise(own).alias("x")).select("dir", "x.cluster", "x.place"))
        new = waits.join(got.withColumnRenamed("dir", "on"), "on").join(held.select("cluster", F.col("own").alias("on")), ["cluster", "on"], "left_anti")
        votes = durable(votes.unionByName(new.select("dir", "cluster", "place", F.lit(1).cast("long").alias("n"))))
        open_ = durable(open_.join(got.select(F.col("dir").alias("on")), "on", "left_anti").select("dir", "on"))
        todo = durable(todo.join(got, "dir", "left_anti"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        return rows.select(F.col("path").cast("string").alias("path"), F.lit(None).cast("string").alias("cluster")).limit(0)
    return rows.join(out, "dir").select("path", "cluster")


def split_large(cluster_files: DataFrame, most: int) -> DataFrame:
    """cluster_files: cluster, path, pos, tokens, is_root.  Adds part: clusters above ``most`` tokens have their
    roots as part 0 and the others in runs of max(5, a third) from 1; others stay whole (part null)."""
    whole = Window.partitionBy("cluster")
    large = F.sum("tokens").over(whole) > most
    rest = Window.partitionBy("cluster", "is_root")
    size = F.greatest(F.lit(5), F.ceil(F.count(F.lit(1)).over(rest) / 3))
    run = F.floor((F.row_number().over(rest.orderBy("pos", "path")) - 1) / size) + 1
    return cluster_files.withColumn("part", F.when(large, F.when(F.col("is_root"), 0).otherwise(run)).cast("int"))


def in_order(clusters: DataFrame) -> DataFrame:
    """Clusters by priority (high, medium, low), then most tokens."""
    p = F.col("priority")
    return clusters.orderBy(F.when(p == "high", 0).when(p == "medium", 1).otherwise(2), F.desc("tokens"), "cluster")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """clusters: cluster, n_files, tokens.  One row: n_clusters, n_files, tokens, mean (rounded)."""
    out = clusters.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return out.withColumn("mean", F.when(F.col("n_clusters") > 0, F.round(F.col("tokens") / F.col("n_clusters"))).otherwise(0).cast("long"))


def orphan_homes(orphans: DataFrame, cluster_dirs: DataFrame) -> DataFrame:
    """orphans: dir; cluster_dirs: cluster, dir, ord.  (dir, cluster, overlap): the cluster with most of its
    directories equal to, below or above the directory, the first of equals; ancestors are listed and
    joined on equality."""
    up = lambda d: F.array_union(F.array(d), ancestors(d))
    rows = cluster_dirs.select("cluster", "ord", "dir")
    count = rows.count()
    held = spread(rows, "cluster", "dir", count=count).distinct()
    o = orphans.select("dir").distinct()
    # as rows of both are distinct, and ``above`` are those above only, none arises twice
    below = held.select("cluster", "ord", F.col("dir").alias("own"), F.explode(up(F.col("dir"))).alias("dir")).join(o, "dir").select("dir", "cluster", "ord", "own")
    above = o.select("dir", F.explode(ancestors(F.col("dir"))).alias("up")).join(held.withColumnRenamed("dir", "up"), "up").select("dir", "cluster", "ord", F.col("up").alias("own"))
    n = spread(below.unionAll(above), "dir", "cluster", count=3 * count).groupBy("dir", "cluster", "ord").agg(F.count(F.lit(1)).alias("overlap"))
    return n.groupBy("dir").agg(F.max_by(F.struct("cluster", "overlap"), F.struct("overlap", -F.col("ord"))).alias("x")).select("dir", "x.cluster", "x.overlap")


def cluster_id(name: Column) -> Column:
    """A name as an id: path_id with single - for _ and no - at its ends."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(path_id(name), "_", "-"), "--+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("cluster"))


def best_segment(path: Column, excluded: list[str]) -> Column:
    """The deepest directory of a path that says something, else the deepest; empty without a directory."""
    parts = F.split(dirname(path), "/")
    good = F.filter(parts, lambda x: ~x.isin(*excluded))
    return F.when(dirname(path).isin(".", ""), "").otherwise(F.coalesce(F.try_element_at(good, F.lit(-1)), F.element_at(parts, -1)))


def scope(files: Column, name: Column, excluded: list[str]) -> Column:
    """The deepest segment of the files' common directory that is neither the name nor excluded; empty if none."""
    common = F.split(common_directory(files), "/")
    left = F.filter(common, lambda x: (x != "") & (x != ".") & (F.lower(F.regexp_replace(x, "^_", "")) != F.lower(name)) & ~x.isin(*excluded))
    return F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit(""))


def named(cluster_files: DataFrame, excluded: list[str]) -> DataFrame:
    """cluster_files: cluster, path, ord (of the cluster), component (of the file, may be null), is_root.

    (cluster, name, scope, id, label): the directory that most files are in (the first met of equals) if it
    has 30 % of them, else the component found first there, else the root's component or name, else
    the first file's directory; behind the scope, where there is one; see ``unique_ids``.  The label
    is the first component's, by path, else the common directory's, the first file's or the file's.
    """
    rows = cluster_files.withColumn("segment", best_segment(F.col("path"), excluded))
    per = rows.filter((F.col("segment") != "") & ~F.col("segment").isin(*excluded)).groupBy("cluster", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.min_by("component", F.when(F.col("component").isNotNull(), F.col("path"))).alias("component"))
    best = per.groupBy("cluster").agg(F.min_by(F.struct("segment", "n", "component"), F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    root = F.struct("component", F.lower(stem(F.col("path"))).alias("stem"))
    whole = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("ord"), F.min_by(root, F.when(F.col("is_root"), F.col("path"))).alias("root"), F.min(dirname(F.col("path"))).alias("dir"), F.array_sort(F.collect_list("path")).alias("files"), F.min_by("component", F.when(F.col("component").isNotNull(), F.col("path"))).alias("label_name"))
    rows = whole.join(best, "cluster", "left")
    enough = F.col("b.n") >= F.greatest(F.lit(1), F.round(F.col("size") * MAJORITY))
    fallback = F.coalesce(F.lower(F.col("b.component")), F.lower(F.col("root.component")), F.col("root.stem"), F.when(F.col("dir") != ".", F.col("dir")), F.lit("cluster"))
    rows = rows.withColumn("name", F.when(enough, F.col("b.segment")).otherwise(fallback))
    rows = rows.withColumn("common", common_directory(F.col("files")))
    rows = rows.withColumn("scope", scope(F.col("files"), F.col("name"), excluded))
    n, s = cluster_id(F.col("name")), cluster_id(F.col("scope"))
    rows = rows.withColumn("base", F.when((F.col("scope") == "") | (n == s), n).otherwise(F.concat(s, F.lit("-"), n)))
    ids = unique_ids(rows.select("cluster", "ord", "base"))
    shown = F.coalesce(F.concat(F.col("label_name"), F.lit(LABELS["component"])), F.concat(F.coalesce(F.nullif("common", F.lit("")), F.nullif("dir", F.lit("")), F.col("files")[0]), F.lit(LABELS["module"])))
    return rows.join(ids, "cluster").select("cluster", "name", "scope", "id", shown.alias("label"))


def unique_ids(rows: DataFrame) -> DataFrame:
    """rows: cluster, ord, base (wanted id).  (cluster, id): in order, the base if it is free, else the base with the
    first number from 2 that is.

    Only bases that are equal but for numbers at their ends can meet.  Where all of these are one base,
    places in its order are the numbers; the names of the others, which are few, are settled one
    after the other, a family a group.
    """
    family = F.regexp_replace("base", r"(-\d+)+$", "")
    rows = rows.withColumn("_family", family)
    mixed = rows.groupBy("_family").agg((F.min("base") != F.max("base")).alias("_mixed"))
    rows = durable(rows.join(mixed, "_family"))
    plain = ranked(rows.filter(~F.col("_mixed")).select("cluster", "ord", "base"), ["base"], ["ord", "cluster"], "_k")
    plain = plain.select("cluster", F.when(F.col("_k") > 0, F.concat("base", F.lit("-"), (F.col("_k") + 1).cast("string"))).otherwise(F.col("base")).alias("id"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used, tried, out = set(), {}, []
        for base in (pdf := pdf.sort_values(["ord", "cluster"]))["base"]:
            name, k = base, tried.get(base, 2)
            while name in used:
                name, k = f"{base}-{k}", k + 1
            tried[base] = max(2, k - 1)
            used.add(name)
            out.append(name)
        return pd.DataFrame({"cluster": pdf["cluster"], "id": out})

    kind = rows.schema["cluster"].dataType.simpleString()
    return plain.unionByName(rows.filter("_mixed").groupBy("_family").applyInPandas(settle, f"cluster {kind}, id string"))


def majority_directory(cluster_files: DataFrame, excluded: list[str]) -> DataFrame:
    """(cluster, segment, n): the commonest directory segment that says something, if 30 % of the files agree."""
    rows = cluster_files.withColumn("segment", best_segment(F.col("path"), excluded))
    size = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    best = rows.filter((F.col("segment") != "") & ~F.col("segment").isin(*excluded)).groupBy("cluster", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    best = best.groupBy("cluster").agg(F.min_by(F.struct("segment", "n"), F.struct((-F.col("n")).alias("d"), "first")).alias("b")).select("cluster", "b.*")
    return best.join(size, "cluster").filter(F.col("n") >= F.greatest(F.lit(1), F.round(F.col("size") * MAJORITY))).select("cluster", "segment", "n")


def priority_order(p: Column) -> Column:
    return F.regexp_extract(p, r"P(\d)", 1).try_cast("int")
