"""Conversation structure repair: the cheapest edits that make roles alternate, by forward Viterbi steps.

A repaired conversation's role initials are ``(s?(ua)+)?``.  Four states say what was kept last: nothing,
s, u or a.  A layer holds for every state the least (cost, audit string); it is closed with at most two
inserts, then a row is kept, reroled or deleted.  Of two audits of one cost that end in one state after
the same rows none is the beginning of the other (it would have fewer inserts and cost less), so that the
lesser stays the lesser whatever follows: the forward choice is the least whole audit, and rows may be
folded in parts.

Rows are sorted by ranges of (conversation, turn, role, text) and numbered by place, so that a long
conversation lies in many partitions.  Each 1024 places of a conversation become a string of row classes
and this a matrix (from each state to each state); a conversation's matrices are folded in order, with
ranks instead of whole audits, which gives each part its edits.  Edits and rows then meet in one sorted
stream for each conversation.  Only that stream, which the hash of a whole conversation asks for, and the
fold of matrices run through a conversation in one task; they hold a batch and the audit.

Cases: null roles and texts are one blank, null conversations are one conversation, null turns come
first; rows of one turn are ordered by role and text; a row without any visible character is blank, whatever
its length; roles are told by their first character, others than s, u and a never stay; an empty table gives
no rows; a conversation all of whose rows go is a row of zeros; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import durable

#: Places of a conversation that one matrix covers, as bits.
PART_BITS = 10
#: Row classes: three for each of the initials s, u, a and any other: fine, to be deleted, truncated.
CLASSES = "ABCDEFGHIJKL"
Layer = list  # of (cost, audit) or None by state: nothing yet, s, u, a


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The planted faults: by a hash of conversation and turn a row goes, loses its text or its stops, comes twice, or is the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), (F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20).alias("_x")).filter("_x <> 0")
    text = F.when(F.col("_x") == 1, "").when(F.col("_x") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_x") == 4, "user").otherwise(F.col("role"))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_x") == 3, 2).otherwise(1))).alias("_c")).drop("_c")


def in_order(rows: DataFrame) -> DataFrame:
    """Adds ``at``, a place that grows with (conv_id, turn, role, text); durable, as places must not change."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.withColumn("_head", F.substring("text", 1, 32)).repartitionByRange(*order, "_head").sortWithinPartitions(*order, "text")
    return durable(dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")))


def classes(ordered: DataFrame) -> DataFrame:
    """conv_id, at, code: the class of each row; the first fault counts."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    stopped = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = ordered.select("conv_id", "at", F.substring("role", 1, 1).alias("_i"), blank.alias("_blank"), stopped.alias("_stopped"))
    keyed = ordered.select("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("_t"), "at")
    first = keyed.groupBy("conv_id", "role", "_t").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    rank = F.when(F.col("_i") == "s", 0).when(F.col("_i") == "u", 1).when(F.col("_i") == "a", 2).otherwise(3)
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(~F.col("_stopped"), "truncated")
    number = F.when(fault.isin("blank", "duplicate"), 1).when(fault == "truncated", 2).otherwise(0)
    got = rows.join(first, "at", "left")  # places are alone: no key is hot
    return got.select("conv_id", "at", F.substring(F.lit(CLASSES), rank * 3 + number + 1, F.lit(1)).alias("code"), fault.alias("fault"))


def closed(layer: Layer) -> Layer:
    """With at most two inserts behind each state."""
    out = list(layer)
    for state, x in enumerate(layer):
        if x is not None:
            once = 3 if state == 2 else 2
            for more, to in (("I", once), ("II", 5 - once)):
                new = (x[0] + 2 * len(more), x[1] + more)
                if out[to] is None or new < out[to]:
                    out[to] = new
    return out


def step(layer: Layer, code: str) -> Layer:
    """A row is deleted (3), kept (0) or reroled (2); what stays truncated costs 1."""
    initial, fault = divmod(CLASSES.index(code), 3)
    out: Layer = [None] * 4
    for state, x in enumerate(layer):
        if x is None:
            continue
        ways = [(state, 3, "D")]
        if fault != 1:
            to, cost = (3 if state == 2 else 2), fault // 2
            ways.append((to, cost + 2, "R"))
            if initial == 0 and state == 0:
                ways.append((1, cost, "K"))
            elif initial == to - 1:
                ways.append((to, cost, "K"))
        for to, cost, letter in ways:
            new = (x[0] + cost, x[1] + letter)
            if out[to] is None or new < out[to]:
                out[to] = new
    return out


@lru_cache(maxsize=20_000)
def matrix(codes: str) -> tuple[Layer, ...]:
    """From each state, the layer behind these rows, not closed."""
    out = []
    for state in range(4):
        layer: Layer = [None] * 4
        layer[state] = (0, "")
        for code in codes:
            layer = step(closed(layer), code)
        out.append(layer)
    return tuple(out)


def initials(codes: str) -> str:
    return "".join("suao"[CLASSES.index(c) // 3] for c in codes)


def illegal(said: str) -> int:
    return sum(said[k : k + 2] not in ("su", "ua", "au") for k in range(len(said) - 1))


class Fold:
    """Folds a conversation's parts; for each state cost, rank among the audits, and the parts behind it."""

    def __init__(self) -> None:
        self.layer: Layer = [(0, 0, None), None, None, None]
        self.firsts, self.illegal, self.before = [], 0, ""

    def add(self, first: int, layers: list[Layer], bad: int, ends: str) -> None:
        self.illegal += bad + (illegal(self.before + ends[0]) if self.before else 0)
        self.firsts.append(first)
        self.before = ends[-1]
        best: Layer = [None] * 4
        for state, x in enumerate(self.layer):
            for to, y in enumerate(layers[state]):
                if x is not None and y is not None and (best[to] is None or (x[0] + y[0], x[1], y[1]) < best[to][:3]):
                    best[to] = (x[0] + y[0], x[1], y[1], (x[2], y[1]))
        ranks = {key: k for k, key in enumerate(sorted(b[1:3] for b in best if b))}
        self.layer = [b and (b[0], ranks[b[1:3]], b[3]) for b in best]

    def end(self) -> tuple[int, list[str]]:
        """The cost and the edits of each part; inserts at the end belong to the last."""
        tails = ("", "II", "I", "")
        cost, _, tail, link = min((x[0] + 2 * len(t), x[1], t, x[2]) for x, t in zip(self.layer, tails) if x)
        parts = []
        while link is not None:
            link, part = link
            parts.append(part)
        parts = parts[::-1] or [""]
        parts[-1] += tail
        return cost, parts


def _runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Rows of each value of a column, in streams sorted by it, over the ends of batches."""
    rows = (r for b in batches for k in range(0, b.num_rows, 512) for r in zip(*[c.to_pylist() for c in b.slice(k, 512).columns]))
    yield from groupby(rows, lambda r: r[key])


def edits(coded: DataFrame, part_bits: int = PART_BITS) -> DataFrame:
    """A row for each part of a conversation: conv_id, at (its first place), edits; and on the last part cost and illegal."""
    kind = coded.schema["conv_id"].dataType.simpleString()
    parts = coded.groupBy("conv_id", F.shiftright("at", part_bits).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("_x"))
    codes = parts.select("conv_id", F.col("_x")[0]["at"].alias("at"), F.array_join(F.transform("_x", lambda x: x["code"]), "").alias("codes"))

    def to_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.column(2).to_pylist()
            layers = [[x for layer in matrix(c) for x in layer] for c in got]
            said = [initials(c) for c in got]
            cols = [pa.array([[x and x[0] for x in m] for m in layers], pa.list_(pa.int64())), pa.array([[x and x[1] for x in m] for m in layers], pa.list_(pa.string())), pa.array([illegal(x) for x in said], pa.int64()), pa.array([x[0] + x[-1] for x in said], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["conv_id", "at", "costs", "audits", "bad", "ends"])

    rows = codes.mapInArrow(to_matrix, f"conv_id {kind}, at long, costs array<long>, audits array<string>, bad long, ends string")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in _runs(batches):
            f = Fold()
            for _, at, costs, audits, bad, ends in own:
                flat = [None if c is None else (c, a) for c, a in zip(costs, audits)]
                f.add(at, [flat[k : k + 4] for k in range(0, 16, 4)], bad, ends)
            cost, said = f.end()
            last = [None] * (len(said) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(said), ids), pa.array(f.firsts, pa.int64()), pa.array(said, pa.string()), pa.array([*last, cost], pa.int64()), pa.array([*last, f.illegal], pa.int64())], names=["conv_id", "at", "edits", "cost", "illegal"])

    ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(fold, f"conv_id {kind}, at long, edits string, cost long, illegal long")


def _stream(ordered: DataFrame, planned: DataFrame) -> DataFrame:
    """Parts' edits and rows in one stream for each conversation: conv_id, at, role (null: a part's edits), text, turn."""
    rows = ordered.select("conv_id", "at", F.lit(1).alias("_k"), "role", "text", "turn")
    heads = planned.select("conv_id", "at", F.lit(0).alias("_k"), F.lit(None).cast("string").alias("role"), F.col("edits").alias("text"), F.lit(None).cast(ordered.schema["turn"].dataType).alias("turn"))
    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.col("at"), "_k").drop("_k")


def _walk(rows: Iterator[tuple], seen: list | None = None, audit: list | None = None) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what a repaired conversation holds, from the stream of its rows; ``seen``
    gets the first turn, the number of turns and the last one, ``audit`` the parts' edits."""
    todo: Iterator[str] = iter("")
    count = 0

    def item(letter: str, role: str, text: str) -> tuple[str, str, str]:
        nonlocal count
        count += 1 if count or letter != "K" or role[:1] != "s" else 0
        if letter != "K":
            role = "user" if count % 2 else "assistant"
        return letter, role, text

    for _, _, role, text, turn in rows:
        if role is None:  # the edits of the next part; what is left of the last are inserts
            todo = iter(text)
            if audit is not None:
                audit.append(text)
            continue
        if seen is not None and turn is not None:
            first, n, last = seen or (turn, 0, None)
            seen[:] = first, n + (last != turn), turn
        for letter in todo:
            if letter == "I":
                yield item("I", "", "")
                continue
            if letter != "D":
                yield item(letter, role, text)
            break
    for letter in todo:  # inserts behind the last row
        yield item(letter, "", "")


def repaired(rows: DataFrame, **columns: str) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text and the edit (K, R or I) of each row."""
    ordered = in_order(_named(rows, **columns))
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (ids, pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text", "edit"])

        for conv, own in _runs(batches):
            for k, (letter, role, text) in enumerate(_walk(own)):
                out.append((conv, k, role, text, letter))
                if len(out) >= 1000:
                    yield full()
        yield full()

    return _stream(ordered, edits(classes(ordered))).mapInArrow(work, f"conv_id {kind}, place long, role string, text string, edit string")


def _named(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))


def audits(rows: DataFrame, part_bits: int = PART_BITS, **columns: str) -> DataFrame:
    """Per conversation with a row: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ordered = in_order(_named(rows, **columns))
    kind = ordered.schema["conv_id"].dataType.simpleString()
    coded = durable(classes(ordered))
    planned = durable(edits(coded, part_bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (ids, pa.int64(), pa.string(), pa.string()))], names=["_conv", "gaps", "audit", "repaired_sha256"])

        for conv, own in _runs(batches):
            seen, said, digest, first = [], [], hashlib.sha256(), True
            for _, role, text in _walk(own, seen, said):
                digest.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
                first = False
            out.append((conv, seen[2] - seen[0] + 1 - seen[1] if seen else 0, "".join(said), digest.hexdigest()))
            if len(out) >= 1000:
                yield full()
        yield full()

    hashed = _stream(ordered, planned).mapInArrow(work, f"_conv {kind}, gaps long, audit string, repaired_sha256 string")
    faults = coded.groupBy(F.col("conv_id").alias("_conv_f")).agg(*[F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")])
    totals = planned.filter("cost is not null").select("conv_id", "cost", "illegal")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    joined = totals.join(faults, same("conv_id", "_conv_f")).join(hashed, same("conv_id", "_conv"))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame, part_bits: int = PART_BITS, **columns: str) -> DataFrame:
    """``audits`` of damaged conversations, and a row of zeros for those that lost all rows."""
    got = audits(damage(conversations, **columns), part_bits)
    every = conversations.select(F.col(columns.get("conv_col", "conv_id")).alias("_id")).distinct()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return every.join(got, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
