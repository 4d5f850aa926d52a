"""Folds along the ordered rows of a key, for keys of any length.

Rows are dealt into ranges of (key, order), sorted and made durable, so that a long key lies in many
partitions and a partition holds whole keys but for its first and its last.  A fold then takes two
passes: every range is folded by itself, the few folds of ranges are carried along each key, and what
is carried into a range is added to its rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import durable

#: Weights that are no whole numbers count in millionths.
UNIT = 1_000_000
#: Rows of a range, which a task may hold as a whole.
RANGE_ROWS = 250_000
PART_BITS = 33  # of ``monotonically_increasing_id``: the partition is above them


def ranged(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows in ranges of (key, order) of some ``RANGE_ROWS``, with their place ``_at``."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANGE_ROWS))
    return durable(df.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order).withColumn("_at", F.monotonically_increasing_id()))


def running(df: DataFrame, key: list[str], order: list[str], folds: dict[str, tuple[str, Column]], behind: bool = False) -> DataFrame:
    """Adds name: fold ("min", "max" or "sum") of a column over the rows of a key before a row (``behind``:
    after it); null where there is none.  ``order`` should have no ties, as they are in any order.

    Only a range's first key (``behind``: its last) gets anything carried, so that the table of
    what is carried has at most a row for each partition, and is broadcast.
    """
    way = F.desc if behind else F.asc
    values = {f"_run_v{k}": c for k, (_, c) in enumerate(folds.values())}
    rows = ranged(df.withColumns(values), key, order).withColumn("_run_part", F.shiftright("_at", PART_BITS))
    fold = [getattr(F, f) for f, _ in folds.values()]
    sums = rows.groupBy(*key, "_run_part").agg(*[f(v).alias(v) for f, v in zip(fold, values)])
    along = Window.partitionBy(*key).orderBy(way("_run_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(c).alias(f"_run_k{k}") for k, c in enumerate(key)], F.col("_run_part").alias("_run_p"), *[f(v).over(along).alias(f"_c{v}") for f, v in zip(fold, values)])
    carried = carried.filter(" or ".join(f"_c{v} is not null" for v in values))
    within = Window.partitionBy(*key, "_run_part").orderBy(way("_at")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_l{v}": f(v).over(within) for f, v in zip(fold, values)})
    same = F.col("_run_part") == F.col("_run_p")
    for k, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_run_k{k}"))
    rows = rows.join(F.broadcast(carried), same, "left")
    out = []
    for (name, (f, _)), v in zip(folds.items(), values):
        x, y = F.col(f"_c{v}"), F.col(f"_l{v}")
        both = F.coalesce(x + y, x, y) if f == "sum" else getattr(F, "least" if f == "min" else "greatest")(x, y)
        out.append(both.alias(name))
    return rows.select(*df.columns, *out)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A range as one table; nothing if it has no rows."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _runs(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where a key begins, and the number of rows."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in key:
        x = table.column(c).combine_chunks()
        a, b = x.slice(0, max(0, n - 1)), x.slice(1)
        differ = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), n)


def _head(w: np.ndarray, most: int) -> tuple[int, list[int], list[int], list[int]]:
    """Of a run of weights: their sum; and for each row at which a chunk that comes in could break: the sum
    up to it, the breaks behind a chunk that begins there, and what its last chunk holds."""
    upto = np.cumsum(w)
    after = np.maximum(np.arange(1, len(w) + 1), np.searchsorted(upto, upto - w + most, "right")).tolist()
    breaks, rest = [0] * len(w), [0] * len(w)
    whole, before = int(upto[-1]), (upto - w).tolist()
    for k in range(len(w) - 1, -1, -1):
        j = after[k]
        breaks[k], rest[k] = (0, whole - before[k]) if j == len(w) else (1 + breaks[j], rest[j])
    n = int(np.searchsorted(upto - w, most, "right"))
    return whole, upto[:n].tolist(), breaks[:n], rest[:n]


def next_fit_rows(df: DataFrame, key: list[str], order: list[str], weight: str, most: float) -> DataFrame:
    """Adds chunk (from 0): a chunk ends when the next row would pass ``most``; a row larger than that is one.

    Weights are not negative; a missing one is 0.  In the first pass each range tells, for the keys at
    its ends, what becomes of a chunk that comes in: where it would break, how many chunks
    begin behind that, and how full the last one is.  Following the ranges of a key gives each range the
    chunk and the sum it begins with: a number for each partition, sent to the second pass.
    """
    whole = df.schema[weight].dataType.typeName() in ("byte", "short", "integer", "long")
    number, unit = F.coalesce(F.col(weight), F.lit(0)), 1 if whole else UNIT
    rows = ranged(df.withColumn("_w", (number if whole else F.round(number * UNIT)).cast("long")), key, order)
    limit = int(round(most * unit))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        at, w, part = _runs(table, key), table.column("_w").to_numpy(), int(table.column("_at")[0].as_py()) >> PART_BITS
        for k in sorted({0, len(at) - 2}):
            total, sums, breaks, rest = _head(w[at[k] : at[k + 1]], limit)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (sums, breaks, rest)]
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks().slice(at[k], 1) for c in key], pa.array([part]), pa.array([total], pa.int64()), *lists], names=[*key, "_run_part", "total", "sums", "breaks", "rest"])

    told = rows.select(*key, "_w", "_at").mapInArrow(ends, f"{kinds}, _run_part long, total long, sums array<long>, breaks array<long>, rest array<long>")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk, held, out = None, 0, 0, []
        for b in batches:
            for *own, part, total, sums, breaks, rest in zip(*[c.to_pylist() for c in b.columns]):
                if last is None or own != last:
                    last, chunk, held = own, breaks[0], rest[0]
                    continue
                out.append((part, chunk, held))
                k = bisect_right(sums, limit - held)
                chunk, held = (chunk, held + total) if k == len(sums) else (chunk + 1 + breaks[k], rest[k])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [()] * 3)], names=["part", "chunk", "held"])

    came = told.repartition(*key).sortWithinPartitions(*key, "_run_part").mapInArrow(carry, "part long, chunk long, held long")
    enters = {r.part: (r.chunk, r.held) for r in came.collect()}  # one a partition at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        at, w, part = _runs(table, key).tolist(), table.column("_w").to_numpy(), int(table.column("_at")[0].as_py()) >> PART_BITS
        upto, start = np.cumsum(w), np.zeros(len(w), "i8")
        before, sums = (upto - w).tolist(), upto.tolist()
        for k, (a, b) in enumerate(zip(at, at[1:])):
            first, held = enters.get(part, (0, None)) if k == 0 else (0, None)
            j = a if held is None else bisect_right(sums, before[a] + limit - held, a, b)
            marks = [] if held is None else [j]
            while j < b:
                j = max(j + 1, bisect_right(sums, before[j] + limit, j, b))
                marks.append(j)
            own = np.zeros(b - a + 1, "i8")
            own[[x - a for x in marks]] = 1
            start[a:b] = first + np.cumsum(own)[: b - a]
        yield from table.drop_columns(["_w", "_at"]).append_column("chunk", pa.array(start)).to_batches()

    return rows.mapInArrow(deal, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "chunk long"]))
