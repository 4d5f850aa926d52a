"""Sharding: balanced label propagation over links between equal texts, under the law ``rows``.

Documents with equal texts are linked (a star around the text).  Every linked document starts in
a shard given by its id.  In each round a group looks at the shards of its members, prefers the
one that holds most of them and still has room, and moves there as a whole while that shard's
quota lasts, those that need least first; quotas of a round are split over buckets, so that
acceptance is decided in parallel, and what the buckets leave goes to the least of those refused
there, whatever their size.  Rounds end when no group moves.
Groups larger than a quarter of a shard are split by a hash of the document id first, so that no
task ever meets one whole hot group.  Documents without links then fill what is left, which makes
row counts differ by one at most.  Everything is DataFrame code.

Cases: null text counts as no bytes and as equal to the empty text; repeated rows are separate
documents with a slot each; an empty table gives no rows; columns besides the id and text are not
looked at.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import durable, exact_rank, utf8

#: Rows that one task ranks at a time.
RANK_ROWS = 50_000
#: Groups whose counts may be broadcast, at most.
HOT_GROUPS = 100_000


def rank_bucket(buckets: int, most: int) -> Column:
    """The bucket in which a row of a group's part is ranked: a part's rows stay together, in pieces of some RANK_ROWS."""
    part_rows = F.col("group_size") / F.ceil(F.col("group_size") / most)
    piece = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.lit(1), F.ceil(part_rows / RANK_ROWS)))
    return F.pmod(F.xxhash64("g", "part", piece), F.lit(buckets))


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, group_size: row counts of shards are at most one apart.

    rounds: at most so many; without it, until no group moves (a group moves once).
    """
    text = utf8(F.col(text_col))
    base = durable(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    ))
    total = base.count()
    quota = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    most = max(1, total // shards // 4)
    group = ["g", "text_crc32", "size"]

    # a group's count comes back to its members by a join; groups of more than RANK_ROWS rows, or than
    # their share of all rows if there could be over HOT_GROUPS of these, are broadcast, so that no key
    # of the other join is larger
    large = min(most, max(RANK_ROWS, total // HOT_GROUPS))
    sizes = durable(base.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    hot, cold = F.broadcast(sizes.filter(F.col("group_size") > large)), sizes.filter(F.col("group_size") <= large)
    rest = durable(base.join(hot, group, "left_anti"))  # read several times below
    linked = (
        base.join(hot, group).unionByName(rest.join(cold, group))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("group_size") / most)).cast("int"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int"))
    )
    key = [*group, "part"]
    # (part of a group, shard) -> members there; the whole state of the propagation
    state = durable(linked.groupBy(*key, "shard").agg(F.count(F.lit(1)).alias("n")))
    parts = state.select(*key).distinct().count()
    buckets = max(1, math.ceil(parts / RANK_ROWS))
    spark = docs.sparkSession
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    placed = None
    for _ in itertools.count() if rounds is None else range(rounds):
        free = every.join(state.groupBy("shard").agg(F.sum("n").alias("used")), "shard", "left").select(
            "shard", (quota - F.coalesce("used", F.lit(0))).alias("free")
        )  # one row a shard
        whole = Window.partitionBy(*key)
        seen = state.join(F.broadcast(free), "shard").withColumn("all", F.sum("n").over(whole))
        # prefer the shard with most members among those with room for the rest; keep to one's own if none has
        want = seen.groupBy(*key).agg(
            F.first("all").alias("all"),
            F.max_by("shard", F.struct((F.col("free") >= F.col("all") - F.col("n")).cast("int"), "n", -F.col("shard"))).alias("to"),
            F.max_by("n", F.struct((F.col("free") >= F.col("all") - F.col("n")).cast("int"), "n", -F.col("shard"))).alias("there"),
        )
        want = want.withColumn("need", F.col("all") - F.col("there")).filter("need > 0")
        least = [F.col("need"), *map(F.col, key)]
        turn = Window.partitionBy("to", "b").orderBy(*least)
        upto = turn.rowsBetween(Window.unboundedPreceding, 0)
        want = durable(
            want.withColumn("b", F.pmod(F.xxhash64(*key), F.lit(buckets)))
            .withColumn("sum", F.sum("need").over(upto))
            .join(F.broadcast(free.withColumnRenamed("shard", "to")), "to")
            .withColumn("goes", F.col("sum") <= F.floor(F.col("free") / buckets))
        )
        # what is left goes to the least of those refused, of which each bucket shows an equal part
        left = want.groupBy("to").agg((F.first("free") - F.sum(F.when(F.col("goes"), F.col("need")).otherwise(0))).alias("left"))
        shown = want.filter("not goes").withColumn("k", F.row_number().over(turn)).filter(F.col("k") <= max(1, RANK_ROWS // buckets))
        late = shown.withColumn("sum", F.sum("need").over(Window.partitionBy("to").orderBy(*least).rowsBetween(Window.unboundedPreceding, 0)))
        late = late.join(F.broadcast(left), "to").filter(F.col("sum") <= F.col("left"))
        moves = durable(want.filter("goes").select(*key, "to").unionAll(late.select(*key, "to")))
        if moves.isEmpty():
            break
        state = durable(state.join(moves, key, "left").groupBy(*key, F.coalesce("to", "shard").alias("shard")).agg(F.sum("n").alias("n")))
        placed = moves if placed is None else placed.unionAll(moves)
    out = linked
    if placed is not None:
        out = linked.join(placed, key, "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    out = out.select("doc_id", "size", "text_crc32", "g", "part", "group_size", "shard")
    alone = rest.join(cold.select(*group), group, "left_anti").select("doc_id", "size", "text_crc32", "g", F.lit(0).alias("part"), F.lit(1).cast("long").alias("group_size"), F.lit(None).cast("int").alias("shard"))

    b = max(1, math.ceil(total / shards / RANK_ROWS))
    tie = [F.col("g"), F.col("part"), F.col("doc_id")]
    ranked = exact_rank(out, ["shard"], tie, rank_bucket(b, most), b, "slot")
    kept = durable(ranked.filter(F.col("slot") < quota))
    over = ranked.filter(F.col("slot") >= quota).select(*alone.columns)
    # what is left of each shard is filled in order by the documents without a place
    room = every.join(kept.groupBy("shard").agg(F.count(F.lit(1)).alias("used")), "shard", "left").select("shard", F.coalesce("used", F.lit(0)).alias("used"), (quota - F.coalesce("used", F.lit(0))).alias("room"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    room = room.withColumn("first", F.coalesce(F.sum("room").over(ahead), F.lit(0))).filter("room > 0")
    rest = alone.unionByName(over).withColumn("one", F.lit(0))
    wide = max(1, math.ceil(total / RANK_ROWS))
    rest = exact_rank(rest, ["one"], [F.col("doc_id"), F.col("g")], F.pmod(F.xxhash64("doc_id", "g"), F.lit(wide)), wide, "at")
    ranges = room.agg(F.array_sort(F.collect_list(F.struct("first", "shard", "used"))).alias("ranges"))  # one row for each shard at most
    rest = rest.crossJoin(F.broadcast(ranges)).withColumn("r", F.element_at(F.filter("ranges", lambda x: x["first"] <= F.col("at")), -1))
    rest = rest.select("doc_id", "size", "text_crc32", F.col("r.shard").alias("shard"), (F.col("r.used") + F.col("at") - F.col("r.first")).alias("slot"), "group_size")
    return kept.select("doc_id", "size", "text_crc32", "shard", "slot", "group_size").unionByName(rest)
