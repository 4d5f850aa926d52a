"""Embedding near-dedup: dual traversal of cover trees, exact pairs of cosine 0.93 or more within a label.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), so pairs are found by distance.  Equal
vectors of a label are one class with a weight.  The top level of the tree is distributed: up to
``PIVOTS`` vectors of each label, by a hash, are centres; every vector goes to its nearest one, and
two cells meet only if their centres are no farther apart than their covering radii and the
distance allow; a vector enters only those meetings that its own distance to the other centre
allows.  Large cells are dealt into blocks of ``BLOCK`` at most, so that a task has two blocks.  A
task builds a cover tree of each, nested levels with radii halving from 1, and goes down both at
once, level by level, dropping node pairs whose centres are too far apart for their covering
radii.  What is left at the leaves is compared by cosine in double precision.

A task does not emit pairs: it gives each class the summed weight of those it links with, and one
link that connects it within the task.  Components come from these.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a
null label, link with nothing; repeated rows are separate vectors with cosine 1; vectors of
different length under one label do not link; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, durable
from weftline.llm.jaccard import Merged

COSINE = 0.93
PIVOTS = 16
BLOCK = 2048
RADII = (1.0, 0.5, 0.25, 0.125)
SLACK = 1e-9
STEP = 100_000


class CoverTree:
    """Nested levels: of each node its centre (a row of x), covering radius and children; leaves hold rows."""

    def __init__(self, x: np.ndarray, radii: tuple[float, ...] = RADII):
        self.x = x
        nodes = [np.arange(len(x))]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # centres, radii
        self.children: list[list[np.ndarray]] = []  # of a level's nodes, places in the next level
        for r in radii:
            below, parents = [], []
            for rows in nodes:
                at = len(below)
                below += self._net(rows, r)
                parents.append(np.arange(at, len(below)))
            if self.levels:
                self.children.append(parents)
            nodes = below
            centres = np.array([rows[0] for rows in nodes], int)
            cover = np.array([0.0 if len(rows) == 1 else float(np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(1)).max()) for rows in nodes])
            self.levels.append((centres, cover))
        self.leaves = nodes

    def _net(self, rows: np.ndarray, r: float) -> list[np.ndarray]:
        """Parts whose first row is the centre, all others within r of it, and centres more than r apart."""
        out = []
        while len(rows) > 1:
            near = ((self.x[rows] - self.x[rows[0]]) ** 2).sum(1) <= r * r
            near[0] = True
            out.append(rows[near])
            rows = rows[~near]
        return [*out, *([rows] if len(rows) else [])]


def _grid(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i in left[a[k]] and j in right[b[k]], in arrays of bounded length."""
    i, j, n = [], [], 0
    for p, q in zip(a, b):
        x, y = left[p], right[q]
        wide = max(1, STEP // max(1, len(y)))
        for at in range(0, len(x), wide):
            part = x[at : at + wide]
            i.append(np.repeat(part, len(y))), j.append(np.tile(y, len(part)))
            n += len(i[-1])
            if n >= STEP:
                yield np.concatenate(i), np.concatenate(j)
                i, j, n = [], [], 0
    if n:
        yield np.concatenate(i), np.concatenate(j)


def dual(s: CoverTree, t: CoverTree, within: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate rows (i of s, j of t), by going down both trees; all pairs within ``within`` are among them.
    ``same``: s is t, and only i < j are wanted."""
    (cs, rs), (ct, rt) = s.levels[0], t.levels[0]
    frontier = []
    wide = max(1, STEP * 10 // max(1, len(ct)))
    for at in range(0, len(cs), wide):
        part = slice(at, at + wide)
        d = np.sqrt(np.maximum(2 - 2 * (s.x[cs[part]] @ t.x[ct].T), 0))
        a, b = np.nonzero(d <= rs[part, None] + rt[None, :] + within + SLACK)
        frontier.append((a + at, b))
    a, b = (np.concatenate(z) for z in zip(*frontier))
    for level in range(len(s.levels)):
        if same:
            a, b = a[a <= b], b[a <= b]
        last = level == len(s.levels) - 1
        if last:
            for i, j in _grid(s.leaves, t.leaves, a, b):
                yield (i[i < j], j[i < j]) if same else (i, j)
            # rows of a pair of different leaves may come in either order
            if same:
                far = a < b
                for i, j in _grid(s.leaves, t.leaves, a[far], b[far]):
                    yield j[j < i], i[j < i]
            return
        (cs, rs), (ct, rt) = s.levels[level + 1], t.levels[level + 1]
        found = []
        for i, j in _grid(s.children[level], t.children[level], a, b):
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", s.x[cs[i]], t.x[ct[j]]), 0))
            ok = d <= rs[i] + rt[j] + within + SLACK
            found.append((i[ok], j[ok]))
        a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def block_links(left: pd.DataFrame, right: pd.DataFrame | None, least: float) -> list[tuple[int, int, int]]:
    """(class, summed weight of the classes it links with, a class of the same component in this task)."""
    same = right is None
    both = left if same else pd.concat([left, right], ignore_index=True)
    v = np.stack([np.asarray(x, float) for x in both["v"]])
    norm = np.sqrt((v * v).sum(1))
    unit, ids, w = v / norm[:, None], both["rep"].to_numpy(), both["w"].to_numpy()
    n = len(left)
    s = CoverTree(unit[:n])
    t, at = (s, 0) if same else (CoverTree(unit[n:]), n)
    links, merged = np.zeros(len(both), np.int64), Merged()
    for i, j in dual(s, t, math.sqrt(max(0.0, 2 - 2 * least)), same):
        j = j + at
        for k in range(0, len(i), STEP):
            p, q = i[k : k + STEP], j[k : k + STEP]
            ok = np.einsum("ij,ij->i", v[p], v[q]) / (norm[p] * norm[q]) >= least
            p, q = p[ok], q[ok]
            links += np.bincount(p, w[q], len(both)).astype(np.int64) + np.bincount(q, w[p], len(both)).astype(np.int64)
            for x, y in zip(p.tolist(), q.tolist()):
                x, y = merged.root(x), merged.root(y)
                if x != y:
                    merged[max(x, y)] = min(x, y)
    return [(int(ids[k]), int(links[k]), int(ids[merged.root(int(k))])) for k in np.flatnonzero(links)]


def near_duplicates(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.expr("label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    norm = F.expr("aggregate(v, 0D, (t, x) -> t + x * x)")
    rows = rows.withColumn("v", F.when(fine & (norm > 0) & (norm < float("inf")), F.col("v")))
    # the number of components is part of the label, so that vectors of different length never meet
    valid = rows.filter("v is not null").withColumn("label", F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string")))
    classes = valid.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    classes = durable(classes)
    unit = F.expr("transform(v, x -> x / sqrt(aggregate(v, 0D, (t, y) -> t + y * y)))")
    # a label has a centre for each BLOCK of its classes, at most PIVOTS: the lowest hash of each hash bucket
    many = classes.groupBy("label").agg(F.least(F.lit(PIVOTS), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("many"))
    named = classes.join(many, "label").withColumn("h", F.xxhash64("rep"))
    centres = named.groupBy("label", F.pmod("h", F.col("many")).alias("k")).agg(F.min_by(unit, F.struct("h", "rep")).alias("c"))
    centres = centres.groupBy("label").agg(F.collect_list("c").alias("cs"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells, far = [], []
            for v, cs in zip(pdf["v"], pdf["cs"]):
                v = np.asarray(v, float)
                d = np.sqrt(np.maximum(((np.stack(cs) - v / np.sqrt(v @ v)) ** 2).sum(1), 0))
                cells.append(int(d.argmin())), far.append(d.tolist())
            yield pd.DataFrame({"rep": pdf["rep"], "label": pdf["label"], "w": pdf["w"], "v": pdf["v"], "i": cells, "d": far})

    placed = durable(classes.join(centres, "label").select("rep", "label", "w", "v", "cs").mapInPandas(assign, "rep long, label string, w long, v array<double>, i int, d array<double>"))
    stats = placed.groupBy("label", "i").agg(F.max(F.element_at("d", F.col("i") + 1)).alias("r"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    stats = stats.groupBy("label").agg(F.collect_list(F.struct("i", "r", "k")).alias("cells"))  # at most PIVOTS a label
    within = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    met = placed.join(stats, "label").withColumn("own", F.expr("filter(cells, c -> c.i = i)[0]"))
    met = met.withColumn("bi", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("own.k")).cast("int"))
    meets = F.expr(f"""
        flatten(transform(filter(cells, c -> c.i = i or d[c.i] <= c.r + {within!r}), c ->
            transform(sequence(0, c.k - 1), b -> if(struct(i as i, bi as b) <= struct(c.i as i, b as b),
                struct(i as i, bi as bi, c.i as j, b as bj, 0 as side), struct(c.i as i, b as bi, i as j, bi as bj, 1 as side)))))
    """)  # fmt: skip
    dealt = met.select("label", "rep", "w", "v", F.explode(meets).alias("m")).select("label", "m.*", "rep", "w", "v")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        one = pdf["i"].iloc[0] == pdf["j"].iloc[0] and pdf["bi"].iloc[0] == pdf["bj"].iloc[0]
        left = pdf if one else pdf[pdf["side"] == 0].reset_index(drop=True)
        right = None if one else pdf[pdf["side"] == 1].reset_index(drop=True)
        found = [] if right is not None and not (len(left) and len(right)) else block_links(left.reset_index(drop=True), right, least)
        return pd.DataFrame(found, columns=["rep", "links", "to"]).astype("int64")

    found = durable(dealt.groupBy("label", "i", "bi", "j", "bj").applyInPandas(work, "rep long, links long, to long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(None, found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("rep"), "component")
    by_class = classes.join(links, "rep", "left").join(comp, "rep", "left").select("rep", "label", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of_valid = valid.join(by_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    out = of_valid.unionByName(rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
