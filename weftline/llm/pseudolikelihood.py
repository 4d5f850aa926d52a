"""LM scoring: masked pseudo-likelihood of a bidirectional window network trained in numpy.

Words of all documents are counted.  The commonest ``VOCAB - HASHED`` have a number each; every
other word has the number of its ending, of which there are ``HASHED``, and its own share of that
ending's count, so that every word has its own probability.  Shares are read from a table of counts
of all words seen twice or more, in slots by a hash, eight slots a word up to ``MOST_BITS``: it grows
with the words of the corpus (words that meet in a slot add up; beyond ``MOST_BITS``, a bound on the
workers' memory, more of them do).

A network sees the two words before and the two behind a place, never the word itself, and predicts
its number in two steps, the class of the number and the number in the class.  Texts become numbers
once, in the shared folder.  Training is data-parallel: in each of ``ROUNDS`` rounds every task trains
on every ``STRIDE``-th place of its share of all documents, the rounds on different ones, so that
after the last every place has been a target once; tasks start a round from the same parameters, and
the results are averaged by the places they saw, in two levels of sums, so that what is gathered
follows the input while the parameters keep their size.  A document's score is the sum of its words'
conditional log-probabilities.  How documents are dealt into partitions moves scores slightly.

Cases: null and empty texts have no words and score 0; the places beyond a text's ends are one
padding number; texts of any length are read whole; repeated rows give repeated results; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, durable

CLASSES, SIZE = 32, 32
VOCAB = CLASSES * SIZE
HASHED = 64
DIM, HIDDEN, SIDE = 16, 32, 2
#: As many rounds as a stride has phases: every word place is a training target, once.
STRIDE, ROUNDS, BATCH = 2, 2, 2048
#: The largest table of counts has 2 ** MOST_BITS slots of one byte.
MOST_BITS = 26
#: Slots (a byte each) that one row holds on their way.
PART = 1 << 14
SHAPES = {"e": (VOCAB + 1, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "i": (CLASSES, HIDDEN, SIZE), "ib": (CLASSES, SIZE)}
Params = dict[str, np.ndarray]
TOKENS = "doc_id long, ids binary, n_tokens long, share double"


@dataclass
class Vocabulary:
    """words and counts of the commonest; counts of the endings of all others; slots with eight times the
    logarithm to base 2 of the counts of words seen twice or more."""

    words: list[bytes]
    counts: list[int]
    endings: list[int]
    bits: int
    table: np.ndarray


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % HASHED


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """Counts over all documents; ties of the commonest by word."""
    found = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[\x20\x09-\x0D]+")).alias("w")).filter("w <> ''")
    counts = durable(found.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.desc("n"), "w").limit(VOCAB - HASHED).collect()
    last = F.expr(f"pmod(crc32(substring(cast(w as binary), -2, 2)), {HASHED})")
    rows = counts.groupBy(last.alias("k")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("m")).collect()  # one row an ending
    words, sums = [r["w"].encode() for r in top], dict.fromkeys(range(HASHED), 0) | {r["k"]: r["n"] for r in rows}
    for w, r in zip(words, top):
        sums[ending(w)] -= r["n"]
    bits = min(MOST_BITS, max(14, math.ceil(math.log2(8 * max(1, sum(r["m"] for r in rows))))))
    table = np.zeros(1 << bits, np.uint8)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Slots of one part after the other; rows come sorted by part."""
        at, held = None, np.zeros(PART)
        for pdf in batches:
            for k, part in pdf.groupby("k"):
                if at is not None and k != at:
                    yield pd.DataFrame({"k": [at], "c": [zlib.compress(np.round(8 * np.log2(np.maximum(held, 1))).astype(np.uint8).tobytes(), 1)]})
                    held[:] = 0
                at = k
                np.add.at(held, part["s"].to_numpy(), part["n"].to_numpy(float))
        if at is not None:
            yield pd.DataFrame({"k": [at], "c": [zlib.compress(np.round(8 * np.log2(np.maximum(held, 1))).astype(np.uint8).tobytes(), 1)]})

    slot = F.shiftrightunsigned(F.xxhash64(F.col("w").cast("binary")), 64 - bits)
    numbered = docs.sparkSession.createDataFrame([(r["w"],) for r in top], "w string")  # these are not looked up
    slots = counts.filter("n > 1").join(F.broadcast(numbered), "w", "left_anti").select(F.floor(slot / PART).cast("int").alias("k"), (slot % PART).cast("int").alias("s"), "n")
    for r in slots.repartition("k").sortWithinPartitions("k").mapInPandas(pack, "k int, c binary").toLocalIterator():  # the table, in parts
        table[r["k"] * PART : (r["k"] + 1) * PART] = np.frombuffer(zlib.decompress(r["c"]), np.uint8)
    return Vocabulary(words, [r["n"] for r in top], [sums[k] for k in range(HASHED)], bits, table)


class Numbers(dict):
    """word -> its number, and above 16 bits eight times the logarithm of its count."""

    def __init__(self, v: Vocabulary):
        super().__init__({w: k for k, w in enumerate(v.words)})
        self.known, self.v = len(self), v
        self.total = np.log(np.maximum(np.array(v.endings, float), 1))

    def __missing__(self, word: bytes) -> int:
        v = self.v
        count = int(v.table[xxhash.xxh64_intdigest(word, 42) >> (64 - v.bits)])
        k = VOCAB - HASHED + ending(word) + (count << 16)
        if len(self) < self.known + 400_000:
            self[word] = k
        return k

    def of(self, text: bytes | None) -> tuple[np.ndarray, float]:
        """The numbers of the words of a lower-case text in UTF-8, and the sum of the logarithms of their shares."""
        words = (text or b"").split()
        got = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        ids = (got & 0xFFFF).astype("<u2")
        rare = got[ids >= VOCAB - HASHED]
        share = (rare >> 16) * (math.log(2) / 8) - self.total[(rare & 0xFFFF) - (VOCAB - HASHED)]
        return ids, float(np.minimum(share, 0).sum())


def tokenise(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (numbers of two bytes), n_tokens, share (the sum of the logarithms of shares)."""
    held = docs.sparkSession.sparkContext.broadcast(v)  # at most 2 ** MOST_BITS bytes and the commonest words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(held.value)
        for batch in chunks(batches):
            got = [numbers.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([len(i) for i, _ in got], pa.int64()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "ids", "n_tokens", "share"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).cast("binary")).mapInArrow(work, TOKENS)


def stream(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts with padding around each, the places of words, and their texts."""
    lengths = np.array([len(x) // 2 for x in ids], np.int64)
    out = np.full(int(lengths.sum()) + SIDE * (len(ids) + 1), VOCAB, np.int32)
    text = np.repeat(np.arange(len(ids)), lengths)
    at = np.arange(len(text)) + SIDE * (text + 1)
    out[at] = np.frombuffer(b"".join(ids), "<u2")
    return out, at, text


def start(v: Vocabulary) -> Params:
    """Small seeded weights; the output biases are the frequencies of numbers."""
    rng = np.random.default_rng(0)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    freq = np.full(VOCAB, 1e-3)
    freq[: len(v.counts)] = np.array(v.counts) + 1.0
    freq[VOCAB - HASHED :] = np.array(v.endings) + 1.0
    freq = (freq / freq.sum()).reshape(CLASSES, SIZE)
    p["cb"] = np.log(freq.sum(1)).astype(np.float32)
    p["ib"] = np.log(freq / freq.sum(1, keepdims=True)).astype(np.float32)
    p["b"][:] = 0
    return p


OFFSETS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
#: No logit is taken above this, so that its exponential is finite.
TOP = np.float32(60)
ONES = np.ones(max(CLASSES, SIZE), np.float32)


def _exp(z: np.ndarray) -> np.ndarray:
    np.minimum(z, TOP, out=z)
    return np.exp(z, out=z)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that brings words of one class together, and the part of each class."""
    cls = (target // SIZE).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    return order, [(c, slice(cut[c], cut[c + 1])) for c in range(CLASSES) if cut[c] < cut[c + 1]]


def _within(p: Params, h: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
    """Logits of the numbers in each row's class."""
    z = np.empty((len(h), SIZE), np.float32)
    for c, part in parts:
        np.matmul(h[part], p["i"][c], out=z[part])
        z[part] += p["ib"][c]
    return z


def _picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax at one place of each row."""
    got = np.minimum(z[np.arange(len(z)), at], TOP)
    return got - np.log(_exp(z) @ ONES[: z.shape[1]])


def log_probs(p: Params, ids: np.ndarray, at: np.ndarray, wide: int = 16_384) -> np.ndarray:
    """Of the number at each place, given those around it."""
    tables = [p["e"] @ p["w"][k * DIM : (k + 1) * DIM] for k in range(2 * SIDE)]  # what each number adds at each offset
    out = np.empty(len(at), np.float64)
    for k in range(0, len(at), wide):
        here = at[k : k + wide]
        order, parts = _by_class(ids[here])
        here = here[order]
        target = ids[here]
        h = p["b"] + tables[0][ids[here + OFFSETS[0]]]
        for table, offset in zip(tables[1:], OFFSETS[1:]):
            h += table[ids[here + offset]]
        np.tanh(h, out=h)
        got = _picked(h @ p["c"] + p["cb"], target // SIZE) + _picked(_within(p, h, parts), target % SIZE)
        out[k : k + wide][order] = got
    return out


def _gradient(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The softmax, less one at one place of each row."""
    z = _exp(z)
    z *= (1 / (z @ ONES[: z.shape[1]]))[:, None]
    z[np.arange(len(z)), at] -= 1
    return z


def step(p: Params, seen: Params, ids: np.ndarray, at: np.ndarray, rate: float = 0.3) -> None:
    """One Adagrad step on the places ``at``."""
    order, parts = _by_class(ids[at])
    at = at[order]
    n, target, context = len(at), ids[at], ids[at[:, None] + OFFSETS]
    one = np.ones(n, np.float32)
    x = p["e"][context].reshape(n, -1)
    h = x @ p["w"]
    h += p["b"]
    np.tanh(h, out=h)
    dc = _gradient(h @ p["c"] + p["cb"], target // SIZE)
    di = _gradient(_within(p, h, parts), target % SIZE)
    dh = dc @ p["c"].T
    g = {"c": h.T @ dc, "cb": one @ dc, "i": np.zeros_like(p["i"]), "ib": np.zeros_like(p["ib"])}
    for c, part in parts:
        d = di[part]
        dh[part] += d @ p["i"][c].T
        np.matmul(h[part].T, d, out=g["i"][c])
        g["ib"][c] = one[part] @ d
    h *= h
    dh *= 1 - h  # now the gradient behind tanh
    g |= {"w": x.T @ dh, "b": one @ dh, "e": np.zeros_like(p["e"])}
    dx = (dh @ p["w"].T).reshape(-1, DIM)
    flat = context.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")  # equal numbers together, to be summed
    flat = flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    g["e"][flat[first]] = np.add.reduceat(dx[order], first, axis=0)
    for k, d in g.items():
        d /= n
        seen[k] += d * d
        d *= rate / np.sqrt(seen[k] + 1e-8)
        p[k] -= d


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def train_round(tokens: DataFrame, p: Params, stride: int = STRIDE, phase: int = 0) -> Params:
    """tokens: ids.  Every task trains from p on its documents; parameters are averaged by the places seen."""
    flat = pack(p)
    parts = 8
    width = -(-len(flat) // parts)
    groups = max(1, math.isqrt(tokens.rdd.getNumPartitions()))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, places, skip = unpack(flat), 0, phase
        seen = {k: np.full_like(v, 1e-2) for k, v in own.items()}
        for batch in chunks(batches, 1_000_000):
            ids, at, _ = stream(batch.column(0).to_pylist())
            chosen = at[skip::stride]
            skip = (skip - len(at)) % stride
            for k in range(0, len(chosen), BATCH):
                step(own, seen, ids, chosen[k : k + BATCH])
            places += len(chosen)
        sums = pack(own).astype(np.float64) * places
        g = TaskContext.get().partitionId() % groups
        yield pa.RecordBatch.from_arrays(
            [pa.array([k * groups + g for k in range(parts)], pa.int32()), pa.array([sums[k * width : (k + 1) * width].tobytes() for k in range(parts)], pa.binary()), pa.array([places] * parts, pa.int64())], names=["k", "s", "n"]
        )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums as they come, so that a task holds one sum for each key."""
        total: dict[int, tuple[np.ndarray, int]] = {}
        for pdf in batches:
            for k, s, n in zip(pdf["k"], pdf["s"], pdf["n"]):
                x, m = total.get(k, (0.0, 0))
                total[k] = (x + np.frombuffer(s, np.float64), m + n)
        if total:
            yield pd.DataFrame({"k": list(total), "s": [x.tobytes() for x, _ in total.values()], "n": [m for _, m in total.values()]})

    shape = "k int, s binary, n long"
    sums = tokens.select("ids").mapInArrow(train, shape).repartition(parts * groups, "k").mapInPandas(fold, shape)
    sums = sums.withColumn("k", F.floor(F.col("k") / groups).cast("int")).repartition(parts, "k").mapInPandas(fold, shape)
    got = sorted((r["k"], r["s"], r["n"]) for r in sums.collect())  # a constant size, whatever the input
    if not got or got[0][2] == 0:
        return p
    return unpack(np.concatenate([np.frombuffer(s, np.float64) / n for _, s, n in got]))


def fit(tokens: DataFrame, v: Vocabulary, rounds: int = ROUNDS, stride: int = STRIDE) -> Params:
    p = start(v)
    for k in range(rounds):
        p = train_round(tokens, p, stride, k * stride // max(1, rounds))
    return p


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> tuple[Vocabulary, Params]:
    v = vocabulary(docs, text_col)
    return v, fit(durable(tokenise(docs.withColumn("_id", F.lit(0)), v, "_id", text_col)), v, rounds, stride)


def scored(tokens: DataFrame, p: Params) -> DataFrame:
    """tokens: as ``tokenise`` gives them.  doc_id, n_tokens, log_prob (sum over the words), mean_log_prob."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1_000_000):
            ids, at, text = stream(batch.column(1).to_pylist())
            n = batch.column(2).to_numpy()
            total = np.bincount(text, log_probs(p, ids, at), batch.num_rows).astype(np.float64) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total), pa.array(total / np.maximum(n, 1))], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return tokens.mapInArrow(work, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


def score(docs: DataFrame, model: tuple[Vocabulary, Params], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of every row under a model."""
    return scored(tokenise(docs, model[0], id_col, text_col), model[1])


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents under a model of themselves: their numbers are made once."""
    v = vocabulary(docs, text_col)
    tokens = durable(tokenise(docs, v, id_col, text_col))
    return scored(tokens, fit(tokens, v))
