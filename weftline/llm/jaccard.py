"""N-gram Jaccard join: grouped prefix join over 5-word shingles, exact for a similarity of 0.8 or more.

A document's set holds the 64-bit hashes of its distinct shingles.  Documents with the same set
form a class, and only one of a class goes on.  All sets are put in one order, rare shingles
first; two sets of n and m shingles can link only if the first n - ceil(0.8 n) + 1 of one and the
first m - ceil(0.8 m) + 1 of the other share a shingle.  Classes with the same prefix and size are
collapsed into one group.  Groups that share a prefix shingle become candidate pairs, which are
filtered by size, expanded to their members and verified on whole sets.

Any fixed order is exact; rare first keeps the prefixes free of passages that many documents
share.  Frequencies come from all documents: a sketch of counters whose logarithms travel to the
workers.  It grows with the bytes of the texts, from ``2 ** SKETCH_BITS`` counters for half a GB up to
``2 ** SKETCH_MOST``, a bound on the workers' memory, beyond which more shingles share a counter.

A prefix shingle of more than ``WIDE`` groups does not give all pairs.  Its groups are compared
with four pivots first, which is linear.  Only if the links found so far leave its groups in
different components are these compared with each other, in blocks of bounded size, where pairs
known to be connected are passed over and just the links that connect components leave; shingles
whose groups are much alike are taken together, which compares all pairs of each and more.  So no
link between components is lost, and components are exact.

Cases: null texts and texts without words have no shingles and link with nothing; fewer than five
words make one shingle; repeated rows are in one class; an empty table gives no rows; other
columns are kept by ``keep_one``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import chunks, components, durable, freed, mixed, numbered, renamed, word_hashes

SHINGLE = 5
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that a worker shingles at once.
CHUNK = 2_000_000
#: The least similarity as a fraction of whole numbers.
NUM, DEN = 80, 100
SKETCH_BITS, SKETCH_LEAST, SKETCH_MOST = 22, 16, 24
SKETCH_BYTES = 1 << 29
WIDE = 16
PIVOTS = 4
BLOCK = 2048
#: Rows of ids or pairs of ids (8 or 16 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted set."""
    w, ends = word_hashes(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))  # only A-Z change
    n = max(0, len(w) - SHINGLE + 1)
    h = np.full(n, SHINGLE, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h *= FACTOR
            h += w[k : k + n]
        h = mixed(h)
        for first, last in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if last - first < SHINGLE:  # one shingle of all words, or none
                x = np.uint64(last - first)
                for y in w[first:last]:
                    x = x * FACTOR + y
                out.append(mixed(np.full(min(1, last - first), x, np.uint64)))
                continue
            s = np.sort(h[first : last - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def prefix_length(n: int) -> int:
    return n - math.ceil(NUM * n / DEN) + 1


def sketch_bits(docs: DataFrame, text_col: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 1
    return min(SKETCH_MOST, max(SKETCH_LEAST, SKETCH_BITS + round(math.log2(size / SKETCH_BYTES))))


def sketch(docs: DataFrame, text_col: str = "text", bits: int = SKETCH_BITS) -> np.ndarray:
    """Of each of 2 ** bits counters the rounded double logarithm to base 2 of the shingles counted there, in one byte each.

    Workers count in arrays; parts of 2 ** 14 counters are summed by the cluster, and the driver
    gets one byte for each counter, whatever the input.
    """
    part = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in chunks(batches, CHUNK):
            if got := shingle_sets(batch.column(0)):
                np.add.at(total, (np.concatenate(got) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        rows = total.reshape(-1, part)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["k", "c"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64) for c in pdf["c"])
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "c": [np.round(2 * np.log2(1.0 + total)).astype(np.uint8).tobytes()]})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, c in zip(pdf["k"], pdf["c"]):
                x = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pd.DataFrame({"k": list(sums), "c": [zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1) for x in sums.values()]})

    parts = docs.select(F.col(text_col)).mapInArrow(count, "k int, c binary")
    summed = parts.repartition(F.col("k")).mapInPandas(fold, "k int, c binary").groupBy("k").applyInPandas(add, "k int, c binary")
    with freed(docs.sparkSession):
        got = {r["k"]: r["c"] for r in summed.select("*").collect()}
    return np.concatenate([np.frombuffer(got.get(k, bytes(part)), np.uint8) for k in range((1 << bits) // part)])


def signatures(docs: DataFrame, order: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), key (of the set), prefix (array of long, in the common order)."""
    bits = int(order.size).bit_length() - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in chunks(batches, CHUNK):
            sizes, keys, prefixes = [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    rank = order[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    s = s[np.argsort(rank, kind="stable")[: prefix_length(len(s))]]
                prefixes.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n", "key", "prefix"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(work, "doc_id long, n long, key binary, prefix array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, shingles (sorted hashes as bytes) of the wanted documents (column doc_id); one row an id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK):
            sets = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).join(wanted, "doc_id", "left_semi")
    return rows.mapInArrow(work, "doc_id long, n long, shingles binary")


def _linked(common: int, n: int, m: int) -> bool:
    return DEN * common >= NUM * (n + m - common)


def few(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Ids or pairs of ids, to be broadcast if they are ``most`` rows at most; beyond that an ordinary join stays."""
    ids = durable(ids)
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"s{side}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = sets.join(few(ends), "doc_id", "left_semi")
    both = few(pairs).join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(work, "a long, b long")


def near(n: str, m: str) -> Column:
    """Sizes that a linked pair can have."""
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m))


class Merged(dict):
    """Union-find."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = up = self.get(up, up)
            x = up
        return x


def connect_block(left: pd.DataFrame, right: pd.DataFrame | None) -> list[tuple[int, int]]:
    """Links that join different components among the rows of two blocks (or within one).

    Rows: doc_id, n, c (component so far), shingles.  Overlaps are counted by an index of the
    first block's shingles, so that only shared shingles cost time.
    """
    same, out, merged = right is None, [], Merged()
    right = left if same else right
    sets = [np.frombuffer(s, np.uint64) for s in left["shingles"]]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    n, ids, comp = left["n"].to_numpy(), left["doc_id"].to_numpy(), left["c"].to_numpy()
    for k, (doc, m, c, s) in enumerate(zip(right["doc_id"], right["n"], right["c"], right["shingles"])):
        if (comp == comp[0]).all() and comp[0] == c:
            continue
        s = np.frombuffer(s, np.uint64)
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        hits = [owner[a:b] for a, b in zip(lo, hi) if b > a]
        if not hits:
            continue
        common = np.bincount(np.concatenate(hits), minlength=len(sets))
        ok = (DEN * common >= NUM * (n + m - common)) & (ids != doc) & (comp != c)
        if same:
            ok[k:] = False
        for j in np.flatnonzero(ok):
            a, b = merged.root(int(comp[j])), merged.root(int(c))
            if a != b:
                merged[max(a, b)] = min(a, b)
                out.append((int(ids[j]), int(doc)))
    return out


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, edges): members doc_id, n, rep (class representative); edges a, b between
    representatives, which all link and connect whatever links connect."""
    base = durable(signatures(docs, sketch(docs, text_col, sketch_bits(docs, text_col)), id_col, text_col))
    some = base.filter("n > 0")
    classes = some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    doubled = few(classes.filter("copies > 1").select("key", "rep"))
    # whole prefixes stay where they are: what goes by id or key is small, and broadcast if it is few
    lost = some.select("doc_id", "key").join(doubled, "key").filter("doc_id <> rep").select("doc_id").distinct()
    reps = some.join(few(lost), "doc_id", "left_anti").select("doc_id", "n", "prefix")
    members = base.select("doc_id", "n", "key").join(doubled, "key", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))

    # classes with one prefix and size are one group, known by its smallest member
    grouped = reps.withColumn("p", F.xxhash64("prefix")).select("doc_id", "n", "p", "prefix")
    groups = grouped.select("doc_id", "n", "p").groupBy("n", "p").agg(F.min("doc_id").alias("g"), F.count(F.lit(1)).alias("many"))
    # only groups of several classes need their members listed
    listed = durable(grouped.select("doc_id", "n", "p").join(groups.filter("many > 1"), ["n", "p"]).select("g", "doc_id"))
    heads = grouped.join(few(listed.filter("g <> doc_id").select("doc_id")), "doc_id", "left_anti")
    tokens = heads.select(F.col("doc_id").alias("g"), "n", F.explode("prefix").alias("t"))
    counts = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = durable(tokens.join(counts, "t").select("t", "g", "n", "f"))

    narrow = shared.filter(F.col("f") <= WIDE)
    # lists are short here; equal lists give equal pairs and are taken once
    lists = narrow.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("l")).select("l").distinct()
    pairs = lists.select(F.explode(F.expr(
        f"flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, {WIDE}), y -> {DEN} * least(x.n, y.n) >= {NUM} * greatest(x.n, y.n)), y -> struct(x.g as a, y.g as b))))"
    )).alias("p")).select("p.a", "p.b")

    wide = shared.filter(F.col("f") > WIDE)
    pivots = wide.groupBy("t").agg(F.array_distinct(F.array(F.min(F.struct("g", "n")), *[F.min_by(F.struct("g", "n"), F.xxhash64("g", F.lit(k))) for k in range(1, PIVOTS)])).alias("ps"))
    star = wide.join(pivots, "t").select("g", "n", F.explode("ps").alias("p")).filter(near("n", "p.n") & (F.col("g") != F.col("p.g")))
    star = star.select(F.least("g", "p.g").alias("a"), F.greatest("g", "p.g").alias("b"))
    candidates = durable(pairs.unionAll(star).distinct())

    # expand: members of a group meet their head; a pair of groups with more members than the heads
    # is one more bag for ``settle``, as are a group itself and a wide shingle
    inner = listed.filter("g <> doc_id").select(F.col("g").alias("a"), F.col("doc_id").alias("b"))
    sides = candidates.select(F.xxhash64("a", "b", F.lit("pair")).alias("t"), F.explode(F.array("a", "b")).alias("g"))
    several = sides.join(listed.select("g").distinct(), "g", "left_semi").select("t").distinct()
    outer = sides.join(several, "t", "left_semi").join(listed, "g", "left").select("t", F.coalesce("doc_id", "g").alias("doc_id"))
    own = listed.select(F.xxhash64("g", F.lit("group")).alias("t"), "doc_id")
    grown = wide.select("t", "g").join(listed, "g", "left").select("t", F.coalesce("doc_id", "g").alias("doc_id"))
    bags = durable(grown.unionAll(own).unionAll(outer))
    candidates = durable(candidates.unionAll(inner).distinct())
    open_ids = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).unionAll(bags.select("doc_id")).distinct()
    sets = durable(whole_sets(docs, few(open_ids), id_col, text_col))
    edges = durable(verified(candidates, sets))

    more = settle(bags, edges, sets)
    return members, edges.unionAll(more)


def joined_bags(rows: DataFrame) -> DataFrame:
    """Rows t, doc_id, c, m (the bag's size) of fewer bags, which hold every pair that the given ones hold."""
    # equal bags (by sums of two hashes of their documents) are one
    marks = rows.groupBy("t").agg(
        F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("x"),
        F.sum(F.xxhash64("doc_id", F.lit(2)).cast("decimal(38,0)")).alias("y"),
        F.first("m").alias("m"),
        F.min(F.xxhash64("doc_id", F.lit(4))).alias("s"),
    )
    once = marks.groupBy("x", "y", "m").agg(F.min("t").alias("t"), F.first("s").alias("s"))
    rows = durable(rows.drop("m").join(once.select("t", "s", "m"), "t"))
    # bags with one least hash are much alike and become one, so that a document goes once for all of them, if all together fit a block
    whole = rows.groupBy("s", "doc_id", "c").agg(F.count(F.lit(1)).alias("_n"))
    fit = whole.groupBy("s").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") <= BLOCK)
    apart = rows.join(fit, "s", "left_anti").select("t", "doc_id", "c", "m")
    return durable(apart.unionAll(whole.join(fit, "s").select(F.xxhash64("s", F.lit("joined")).alias("t"), "doc_id", "c", "m")))


def settle(bags: DataFrame, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect components among documents of one bag (t, doc_id)."""
    nodes = bags.select(F.col("doc_id").alias("node")).distinct()
    comp = components(nodes, edges)
    rows = bags.join(comp.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id")
    apart = rows.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi").select("t", "m")
    left = joined_bags(rows.join(apart, "t"))
    left = left.withColumn("k", F.ceil(F.col("m") / BLOCK).cast("int"))
    left = left.withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("k")).cast("int"))
    # block i meets blocks i..k-1: it is sent to the pairs (min, max) that hold it
    dealt = left.select("t", "doc_id", "c", "i", F.explode(F.expr("transform(sequence(0, k - 1), j -> struct(least(i, j) as lo, greatest(i, j) as hi))")).alias("b"))
    sets = sets.join(few(left.select("doc_id").distinct()), "doc_id", "left_semi")
    full = dealt.join(sets, "doc_id").select("t", "b.lo", "b.hi", "i", "doc_id", "n", "c", "shingles")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        pdf = pdf.sort_values("doc_id")
        left = pdf[pdf["i"] == lo]
        if lo == hi:
            found = connect_block(left, None) if len(left) > 1 else []
        else:
            right = pdf[pdf["i"] == hi]
            found = connect_block(left, right) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return full.groupBy("t", "lo", "hi").applyInPandas(work, "a long, b long")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    members, edges = links(docs, id_col, text_col)
    comp = components(None, edges)
    found = members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of its smallest id; of rows with one id that of the smallest text; rows
    without an id stay; the columns they came with.

    Only ids travel: texts move where more rows go, or more ids are repeated, than may be broadcast.
    """
    lost = resolve(docs, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias("_lost")).distinct()
    rows, names = numbered(docs)
    id_col, text_col = names[id_col], names[text_col]
    left = rows.join(few(lost), F.col(id_col) == F.col("_lost"), "left_anti")
    again = few(docs_ids(rows, id_col).groupBy("_id").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_id"))
    first = Window.partitionBy(id_col).orderBy(text_col)
    one = left.join(again, F.col(id_col) == F.col("_id"), "left_semi").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return renamed(left.join(again, F.col(id_col) == F.col("_id"), "left_anti").unionByName(one), names)


def docs_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("_id")).filter("_id is not null")
