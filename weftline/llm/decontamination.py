"""Benchmark decontamination with suffix arrays over the training documents.

Documents are read in shards of bounded bytes, whole documents each.  A shard's words become the
numbers of the test items' words (0 for any other word and behind each document); its suffix array
holds the places from which ``least`` words or more are words of the items, as no shorter match is
asked for, sorted by their words.  Every test suffix is looked up by binary search: the neighbours of
its place give its longest verbatim match and where it is, and the range of places that share its
first words are all occurrences of a window.

The items are sent to the tasks in blocks of bounded bytes; several blocks are several passes over
the documents, whose rows then have a durable number, and a document's hits are united afterwards.

Cases: null texts have no words; items without words match nothing; an item shorter than a window is
one window; documents of any length stay whole; repeated rows are answered each; equal items are all
named, an id that several items share once, a null id as the empty string; without documents there are no rows, without items no
document is contaminated; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, durable, numbered, renamed

WINDOW = 10
#: Bytes of documents in a shard, and of items in a block.
SHARD, BLOCK = 4_000_000, 8_000_000
#: Words are what is left of a text's bytes: a-z (from A-Z too), 0-9 and all that is not ASCII.
WORDS = bytes(x if x in b"0123456789abcdefghijklmnopqrstuvwxyz" or x >= 0x80 else x + 32 if x in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for x in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Tests:
    """The suffixes and windows of test items, as numbers of words."""

    def __init__(self, items: list[tuple], window: int):
        split = [(key, words(text)) for key, text in items]
        split = [(key, w) for key, w in split if w]
        self.ids = [key for key, _ in split]
        self.number: dict[bytes, int] = {}
        flat = [self.number.setdefault(x, len(self.number) + 1) for _, w in split for x in w]
        size = np.array([len(w) for _, w in split], "i8")
        self.words = np.array(flat, "i8")
        self.item = np.repeat(np.arange(len(split)), size)  # of each suffix
        first = np.cumsum(size) - size
        self.at = np.arange(len(flat)) - first[self.item]
        self.left = size[self.item] - self.at  # words of each suffix
        own = np.minimum(size, window)
        is_window = self.left >= own[self.item]
        starts, length = np.flatnonzero(is_window), own[self.item[is_window]]
        seen: dict[bytes, int] = {}  # equal windows are looked up once
        of = [seen.setdefault(self.words[s : s + n].tobytes(), len(seen)) for s, n in zip(starts.tolist(), length.tolist())]
        self.window_of = np.array(of, "i8")
        self.window_item = self.item[starts]
        keep = np.unique(self.window_of, return_index=True)[1] if of else np.zeros(0, "i8")
        self.window_start, self.window_size = starts[keep], length[keep]
        self.least = int(own.min()) if len(split) else 0
        self.most = int(size.max()) if len(split) else 0

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """Items that hold any of these windows."""
        return np.unique(self.window_item[np.isin(self.window_of, windows)])


class Shard:
    """The suffix array of a shard."""

    def __init__(self, docs: list[list[bytes]], tests: Tests):
        get = tests.number.get
        self.size = np.array([len(d) for d in docs], "i8")
        self.first = np.cumsum(self.size + 1) - self.size - 1  # of each document; a 0 is behind each
        n = int((self.size + 1).sum())
        self.words = np.zeros(n + tests.most + 64, "i8")
        at = 0
        for d in docs:
            self.words[at : at + len(d)] = np.fromiter(map(get, d, repeat(0)), "i8", len(d))
            at += len(d) + 1
        zeros = np.append(np.flatnonzero(self.words[:n] == 0), n)
        self.run = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n) if n else np.zeros(0, "i8")
        self.order = self.sorted(np.flatnonzero(self.run >= max(1, tests.least)), tests)

    def key(self, at: np.ndarray, step: int, bits: int) -> np.ndarray:
        out = np.zeros(len(at), "i8")
        for k in range(step):
            out = (out << bits) | self.words[at + k]
        return out

    def sorted(self, places: np.ndarray, tests: Tests) -> np.ndarray:
        """Places in the order of their words, as far as an item could go on."""
        bits = max(1, len(tests.number).bit_length())
        step = max(1, 62 // bits)
        key = self.key(places, step, bits)
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        group = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(places) else places
        depth = step
        while depth < tests.most and len(places):
            n = np.bincount(group)
            open_ = np.flatnonzero((n[group] > 1) & (self.run[places] > depth))  # equal so far, and the match could go on
            open_ = np.flatnonzero(np.isin(group, np.unique(group[open_])))
            if not len(open_):
                break
            key = self.key(places[open_] + depth, min(step, tests.most - depth), bits)
            order = np.lexsort((key, group[open_]))
            places[open_] = places[open_][order]
            changed = np.zeros(len(places), bool)
            changed[1:] = group[1:] != group[:-1]
            changed[open_[1:]] |= key[order][1:] != key[order][:-1]
            group = np.cumsum(changed)
            depth += step
        return places

    def bound(self, at: np.ndarray, size: np.ndarray, tests: Tests, after: bool) -> np.ndarray:
        """Binary search of words ``at`` (of ``size``) of the items: how many suffixes are less, or with ``after`` not greater in these words."""
        low, high = np.zeros(len(at), "i8"), np.full(len(at), len(self.order), "i8")
        while len(now := np.flatnonzero(low < high)):
            mid = (low[now] + high[now]) // 2
            here, there, left = self.order[mid], at[now], size[now]
            sign, open_, k = np.zeros(len(now), "i8"), np.arange(len(now)), 0
            while len(open_):
                x, y = self.words[here[open_] + k], tests.words[there[open_] + k]
                sign[open_] = np.sign(x - y)
                k += 1
                open_ = open_[(x == y) & (left[open_] > k)]
            go = sign <= 0 if after else sign < 0
            low[now[go]], high[now[~go]] = mid[go] + 1, mid[~go]
        return low

    def common(self, rank: np.ndarray, at: np.ndarray, size: np.ndarray, tests: Tests) -> np.ndarray:
        """Words that suffixes of these ranks share with words ``at`` of the items."""
        out = np.zeros(len(at), "i8")
        open_ = np.flatnonzero((rank >= 0) & (rank < len(self.order)))
        while len(open_):
            k = out[open_]
            same = self.words[self.order[rank[open_]] + k] == tests.words[at[open_] + k]
            out[open_[same]] += 1
            open_ = open_[same & (size[open_] > k + 1)]
        return out

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def longest(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """Of every test suffix: the length of its longest match here, and a place of it."""
        at = np.arange(len(tests.words))
        if not len(self.order) or not len(at):
            return np.zeros(len(at), "i8"), np.zeros(len(at), "i8")
        rank = self.bound(at, tests.left, tests, False)
        before, here = (self.common(r, at, tests.left, tests) for r in (rank - 1, rank))
        best = np.where(here >= before, rank, rank - 1)
        return np.maximum(here, before), self.order[np.clip(best, 0, len(self.order) - 1)]

    def windows(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """Of every window: the range of ranks that begin with it."""
        return tuple(self.bound(tests.window_start, tests.window_size, tests, after) for after in (False, True))

    def hits(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which places are hit, and all distinct (document, window) with an occurrence."""
        low, high = self.windows(tests)
        n = high - low
        rank = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        place, window = self.order[rank], np.repeat(np.arange(len(n)), n)
        change = np.zeros(len(self.words) + 1, "i8")
        np.add.at(change, place, 1)
        np.add.at(change, place + tests.window_size[window], -1)
        pairs = np.unique(self.document(place) * max(1, len(n)) + window)
        return np.cumsum(change)[: len(self.run)] > 0, pairs // max(1, len(n)), pairs % max(1, len(n))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int) -> list[list[tuple]]:
    """The items in blocks of some ``block`` bytes; one item at least each, so that an item is never cut."""
    rows = benchmark.select(F.col(id_col).alias("k"), F.col(text_col).cast("binary").alias("t")).filter("t is not null")
    out, size = [[]], 0
    for r in rows.toLocalIterator():
        if size and size + len(r.t) > block:
            out, size = [*out, []], 0
        out[-1].append(("" if r.k is None else r.k, bytes(r.t)))
        size += len(r.t)
    return out


def _shards(batches: Iterator[pa.RecordBatch], shard: int, tests: Tests) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Documents (text in the last column) in shards."""
    for batch in chunks(batches, shard):
        yield batch, Shard([words(t) for t in batch.column(batch.num_columns - 1).to_pylist()], tests)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    blocks = _blocks(benchmark, item_col, item_text, block)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if len(blocks) == 1:
        sent = spark.sparkContext.broadcast(blocks[0])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Tests(sent.value, window)
            for batch, s in _shards(batches, shard, tests):
                hit, doc, win = s.hits(tests)
                n_hit = np.add.reduceat(np.append(hit, False).astype("i8"), s.first) if len(s.first) else s.first
                parts = np.searchsorted(doc, np.arange(len(s.size) + 1))
                found = [sorted({str(tests.ids[x]) for x in tests.items_of(win[i:j]).tolist()}) if i < j else [] for i, j in zip(parts, parts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.size), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()), pa.array(n_hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return rows.mapInArrow(work, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")

    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    passes = None
    for items in blocks:
        sent = spark.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = Tests(sent.value, window)
            for batch, s in _shards(batches, shard, tests):
                hit, doc, win = s.hits(tests)
                edge = np.diff(np.append(np.append(0, hit.astype("i8")), 0))
                start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                parts, spans = np.searchsorted(doc, np.arange(len(s.size) + 1)), np.searchsorted(s.document(start), np.arange(len(s.size) + 1))
                for k in np.flatnonzero(np.diff(parts)).tolist():
                    own = slice(spans[k], spans[k + 1])
                    found = sorted({str(tests.ids[x]) for x in tests.items_of(win[parts[k] : parts[k + 1]]).tolist()})
                    yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], pa.array([(start[own] - s.first[k]).tolist()], pa.list_(pa.int64())), pa.array([(stop[own] - s.first[k]).tolist()], pa.list_(pa.int64())), pa.array([found], pa.list_(pa.string()))], names=["_row", "starts", "stops", "items"])

        got = rows.select("_row", "text").mapInArrow(work, "_row long, starts array<long>, stops array<long>, items array<string>")
        passes = got if passes is None else passes.unionAll(got)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, shard):
            out = []
            for text, starts, stops, items in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3, 4)]):
                n, end, hit = len(words(text)), 0, 0
                for x, y in sorted((x, y) for a, b in zip(starts or [], stops or []) for x, y in zip(a, b)):
                    hit, end = hit + max(0, y - max(x, end)), max(end, y)
                found = sorted({x for i in items or [] for x in i})
                out.append((n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    # a document has one row for each block that it meets
    united = passes.groupBy("_row").agg(*[F.collect_list(c).alias(c) for c in ("starts", "stops", "items")])
    return rows.join(united, "_row", "left").select("doc_id", "text", "starts", "stops", "items").mapInArrow(unite, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(item_id as a string, item_at, n_words, doc_id, doc_at): every test suffix's longest verbatim match of
    ``least`` words or more over all shards, and a document and place (word from 0) of it: the smallest
    of those that the shards offer.  A suffix inside a longer match of the same item is a row too."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = None
    for items in _blocks(benchmark, item_col, item_text, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = Tests(sent.value, least)
            for batch, s in _shards(batches, shard, tests):
                n, place = s.longest(tests)
                ok = np.flatnonzero(n >= least)
                doc = s.document(place[ok])
                yield pa.RecordBatch.from_arrays([pa.array([str(tests.ids[x]) for x in tests.item[ok]], pa.string()), pa.array(tests.at[ok]), pa.array(n[ok]), batch.column(0).take(pa.array(doc)), pa.array(place[ok] - s.first[doc])], names=["item_id", "item_at", "n_words", "doc_id", "doc_at"])

        got = rows.mapInArrow(work, f"item_id string, item_at long, n_words long, doc_id {kind}, doc_at long")
        parts = got if parts is None else parts.unionAll(got)
    best = parts.groupBy("item_id", "item_at").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_at")).alias("b"))
    return best.select("item_id", "item_at", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.doc_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without those that hold a window of an item, with all their columns."""
    rows, names = numbered(docs)
    bad = scan(rows, benchmark, id_col=names[id_col], text_col=names[text_col], **how).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return renamed(rows.join(bad, F.col(names[id_col]).eqNullSafe(F.col("_bad")), "left_anti"), names)
