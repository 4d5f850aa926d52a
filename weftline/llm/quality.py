"""Quality rules: hashed word and character n-gram logistic regression, calibrated, in Arrow batches.

A document has three families of hashed features, each divided by its number in the text: words
(with one marker for words in repeated windows), pairs of words, and runs of four characters.  A
logistic regression is fitted on a bounded sample of labelled rows (``SAMPLE`` labels, those whose
id hashes lowest), its margin calibrated by a second one on the quarter of the sample kept out of
the fit.  Every whole text is scored; fixed thresholds decide.

Cases: a null text has no words and fails the base rule; texts of any length are read whole;
repeated rows give repeated results; without any labelled row of either class the model is
neutral and only the base rule decides; an empty table gives no rows; other columns are kept by
``filter_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import WordHashes, chunks, mixed, numbered, renamed

SAMPLE = 3000
#: Bytes of texts that a worker looks at at once; its arrays take some fifty times as much.
CHUNK = 1_000_000
BITS = 16
#: A document stays if its calibrated probability of good quality is this or more.
KEEP = 0.3
# The base rule.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MARK = np.uint64(0x5EED)


class Texts:
    """Counts and hashed features of a batch of texts, by array operations over all of them."""

    def __init__(self, texts: list[str], hashes: WordHashes):
        self.n = len(texts)
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.ends = np.cumsum([0, *map(len, texts)])
        split = [t.encode().split() for t in texts]
        self.word_ends = np.cumsum([0, *map(len, split)])
        words = [w for s in split for w in s]
        self.words = hashes.of(words)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.word_ends))
        self.texts = texts
        self.repeated = self._repeated(words)

    def per_text(self, flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[ends])

    def _repeated(self, words: list[bytes]) -> np.ndarray:
        """Which words lie in a 3-word window that its text holds twice or more; exact, by numbering."""
        out = np.zeros(len(words), bool)
        if len(words) < 3:
            return out
        codes, known = pd.factorize(np.array(words, dtype=object))
        codes = codes.astype(np.int64)
        pair = pd.factorize(codes[:-1] * len(known) + codes[1:])[0].astype(np.int64)
        triple = pd.factorize(pair[:-1] * len(known) + codes[2:])[0].astype(np.int64)
        inside = np.flatnonzero(self.doc[:-2] == self.doc[2:])
        key = self.doc[inside].astype(np.int64) * len(words) + triple[inside]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = inside[count[back] > 1]
        for k in range(3):
            out[twice + k] = True
        return out

    def counts(self) -> dict[str, np.ndarray]:
        p = self.points
        blank = (p == 32) | ((p >= 9) & (p <= 13))
        symbol = np.zeros(128, bool)
        symbol[[ord(c) for c in "#*$%&|<>"]] = True
        dup = np.zeros(self.n, np.int64)
        for k, t in enumerate(self.texts):
            lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
            dup[k] = len(lines) - len(set(lines))
        return {
            "n_words": np.diff(self.word_ends),
            "word_chars": self.per_text(~blank, self.ends),
            "n_symbols": self.per_text(symbol[np.minimum(p, 127)] & (p < 127), self.ends),
            "n_dup_lines": dup,
            "n_repeat_words": self.per_text(self.repeated, self.word_ends),
        }

    def families(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, slot) of each feature; slots of the families do not meet."""
        shift, size = np.uint64(64 - BITS), 1 << BITS
        w = self.words
        yield self.doc, (w >> shift).astype(np.int64)
        yield self.doc[self.repeated], np.full(int(self.repeated.sum()), int(mixed(np.array([MARK]))[0] >> shift), np.int64)
        inside = self.doc[:-1] == self.doc[1:]
        with np.errstate(over="ignore"):
            pair = mixed(w[:-1] * np.uint64(3) + w[1:])[inside] if len(w) > 1 else w[:0]
        yield self.doc[:-1][inside], size + (pair >> shift).astype(np.int64)
        p = self.points.astype(np.uint64)
        if len(p) > 3:
            with np.errstate(over="ignore"):
                four = (((p[:-3] * np.uint64(1_000_003) + p[1:-2]) * np.uint64(1_000_003) + p[2:-1]) * np.uint64(1_000_003) + p[3:]) * np.uint64(0x9E3779B97F4A7C15)
            text = np.repeat(np.arange(self.n), np.diff(self.ends))
            inside = text[:-3] == text[3:]
            yield text[:-3][inside], 2 * size + (four[inside] >> shift).astype(np.int64)

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Of each text: bias + the mean weight of each family, words and markers by the words' number."""
        out = np.full(self.n, bias)
        n_words = np.maximum(np.diff(self.word_ends), 1)
        for k, (text, slot) in enumerate(self.families()):
            n = n_words if k < 3 else np.maximum(np.diff(self.ends) - 3, 1)
            out += np.bincount(text, weights[slot], self.n) / n
        return out

    def sparse(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n_words = np.maximum(np.diff(self.word_ends), 1)
        texts, slots, values = [], [], []
        for k, (text, slot) in enumerate(self.families()):
            n = n_words if k < 3 else np.maximum(np.diff(self.ends) - 3, 1)
            texts.append(text), slots.append(slot), values.append(1.0 / n[text])
        texts, slots, values = map(np.concatenate, (texts, slots, values))
        key, back = np.unique(texts.astype(np.int64) * (4 << BITS) + slots, return_inverse=True)
        value = np.bincount(back, values, len(key))
        cut = np.searchsorted(key, np.arange(self.n + 1) * (4 << BITS))
        for k in range(self.n):
            at = slice(cut[k], cut[k + 1])
            yield (key[at] % (4 << BITS)).astype(np.int32), value[at].astype(np.float32)


def _texts(batch: pa.RecordBatch, column: int, hashes: WordHashes) -> Texts:
    return Texts([t or "" for t in batch.column(column).to_pylist()], hashes)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from margins to labels (Newton steps, ridge, targets drawn in as by Platt)."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, ab = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ ab)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, x.T @ (p - target)), -2, 2)
    return float(max(ab[0], 1e-3)), float(ab[1])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 30, rate: float = 2.0) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, intercept) from (label, slots, values), in a fixed order: Adagrad, then calibration."""
    weights, bias = np.zeros(4 << BITS), 0.0
    labels = np.array([r[0] for r in rows])
    if len(set(labels.tolist())) < 2:
        return weights, 0.0, 1.0, 20.0  # neutral: probability 1, all stay
    kept_out = np.arange(len(rows)) % 4 == 3
    if len(set(labels[kept_out].tolist())) < 2 or len(set(labels[~kept_out].tolist())) < 2:
        kept_out[:] = False
    seen, seen_bias = np.full(4 << BITS, 1e-6), 1e-6
    order = np.flatnonzero(~kept_out)
    share = labels[order].mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(order):
            label, slot, value = rows[k]
            g = (sigmoid(np.array([bias + weights[slot] @ value]))[0] - label) * weight[k]
            seen[slot] += (g * value) ** 2
            seen_bias += g * g
            weights[slot] -= rate * g * value / np.sqrt(seen[slot])
            bias -= 0.1 * g / np.sqrt(seen_bias)
    test = np.flatnonzero(kept_out) if kept_out.any() else order
    margin = np.array([bias + weights[rows[k][1]] @ rows[k][2] for k in test])
    return weights, bias, *calibrate(margin, labels[test])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float, float, float]:
    """labels: id and 0/1; ids in no document and null labels are left out.  ``sample`` bounds the labelled rows."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    ids = ids.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, CHUNK):
            got = list(_texts(batch, 2, hashes).sparse())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0].tobytes() for x in got], pa.binary()), pa.array([x[1].tobytes() for x in got], pa.binary())], names=["id", "label", "slots", "values"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        # a fixed shuffle, so that the part kept out of the fit does not follow the ids
        parts = [parts[k] for k in np.random.default_rng(1).permutation(len(parts))]
        weights, *rest = fit([(y, np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for _, y, s, v in parts])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()]), *[pa.array([float(x)]) for x in rest]], names=["weights", "bias", "slope", "intercept"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id").select("_id", "_label", "_text")
    sparse = rows.mapInArrow(work, "id long, label int, slots binary, values binary")
    # one task fits the bounded sample; the driver gets the weights alone
    got = sparse.repartition(1).mapInArrow(learn, "weights binary, bias double, slope double, intercept double").first()
    return np.frombuffer(got["weights"], np.float32), got["bias"], got["slope"], got["intercept"]


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float], keep: float = KEEP, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (by default all), the counts, _base_failed, _p_good and _kept of every row."""
    weights, bias, slope, intercept = model
    weights = weights.astype(np.float32)
    carried = docs.columns if carry is None else carry
    schema = T.StructType([*[docs.schema[c] for c in carried], *[T.StructField(f"_{c}", T.LongType()) for c in COUNTS], T.StructField("_p_good", T.DoubleType())])
    docs = docs.select(*carried, F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, CHUNK):
            texts = _texts(batch, len(carried), hashes)
            counts = texts.counts()
            p = sigmoid(slope * texts.margins(weights, bias) + intercept)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], pa.array(p)], names=[*carried, *[f"_{c}" for c in COUNTS], "_p_good"]
            )

    scored = docs.mapInArrow(work, schema)
    failed = (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > int(100 * MOST_REPEATED) * F.col("_n_words"))
    return scored.withColumn("_base_failed", failed).withColumn("_kept", ~failed & (F.col("_p_good") >= keep))


def filter_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows, names = numbered(docs)
    return renamed(score(rows, model, keep, names[text_col]).filter("_kept"), names)
