"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

From labelled text two raw-content dictionaries of equal layout are made.  The toxic one holds the
word beginnings (4 to 12 bytes behind a blank) that a toxic document has many times as often as an
ordinary one, surely so and none the beginning of another, the surest last.  The ordinary one holds
at the same places what ordinary text has of these segments, their longest common endings.  Every
window of 24 lower-cased words is compressed with both, once for matches of 5 bytes and once for
matches of 6; the bytes that the toxic dictionary saves over the ordinary one are that window's
distance.  A logistic curve over a document's distances is calibrated on labelled rows, each under
dictionaries made without it (two folds); a fixed threshold on its score decides.

The segments are chosen by counts, not by zstandard's own trainer: dictionaries that the trainer
makes of each class's text hold what both classes share and do not tell them apart here (see the
README for figures).

Labels are learnt only from rows that ``held_out`` leaves in, at most ``SAMPLE`` of each class
(those whose id hashes lowest), in one task.  Text alone enters a score.

Cases: null and empty texts have distance 0 and get the score of a text without evidence; texts of
any length are read whole, window by window; repeated rows give repeated results; with labels of
one class only, every score is below 1e-12; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks

SAMPLE = 2500
WINDOW = 24
#: Times its number in an ordinary document that a segment's number in a toxic one must be.
CONTRAST = 8
#: Standard errors that it must have more.
SURE = 3.5
THRESHOLD = 0.7
EDGE = b".,;:!?*#$%&|<>()[]\"'"
Model = tuple[bytes, bytes, list[float]]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def _segments(words: list[bytes]) -> dict[bytes, int]:
    """Occurrences of each word beginning, 5 at most, so that no one document rules."""
    out = Counter()
    for w, n in Counter(words).items():
        w = w.strip(EDGE)
        for k in range(4, min(len(w), 12) + 1):
            out[b" " + w[:k]] += n
    return {s: min(n, 5) for s, n in out.items()}


def dictionaries(toxic: list[str], ordinary: list[str], contrast: float = CONTRAST) -> tuple[bytes, bytes]:
    """(toxic, ordinary): contents of the two dictionaries, equally long."""
    split = lambda t: t.lower().encode().split()
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    in_toxic, in_ordinary = Counter(), Counter()
    for t in toxic:
        in_toxic.update(_segments(split(t)))
    for t in ordinary:
        in_ordinary.update({s: n for s, n in _segments(split(t)).items() if s in in_toxic})
    nt, no = len(toxic), max(1, len(ordinary))
    rate = lambda s: (in_toxic[s] / nt, (in_ordinary[s] + 0.5) / no)

    def surplus(s: bytes) -> float:
        """Standard errors by which the toxic rate is above the ordinary one."""
        x, y = rate(s)
        return (x - y) / np.sqrt(x / nt + y / no)

    good = [s for s, c in in_toxic.items() if c >= 5 and rate(s)[0] >= contrast * rate(s)[1] and surplus(s) >= SURE]
    kept: list[bytes] = []
    for s in sorted(good, key=lambda s: (-surplus(s), -len(s), s)):
        if not any(s.startswith(k) or k.startswith(s) for k in kept):
            kept.append(s)
    kept.reverse()
    sample = b"\n".join(b" ".join(split(t)) for t in ordinary[:: max(1, len(ordinary) // 600)])

    def ending(s: bytes) -> bytes:
        for k in range(1, len(s)):
            if sample.count(s[k:]) >= 6:
                return b"\0" * k + s[k:]
        return b"\0" * len(s)

    return b"".join(s + b" " for s in kept), b"".join(ending(s) + b" " for s in kept)


#: Zeros behind a dictionary's last segment, as zstandard does not index its last bytes.
TAIL = b"\0" * 16
MATCHES = (5, 6)


class Distance:
    """Distances of a text's windows under two dictionaries."""

    STRATEGY = 3

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pairs = [(self._compressor(ordinary, m).compress, self._compressor(toxic, m).compress) for m in MATCHES]

    @classmethod
    def _compressor(cls, content: bytes, match: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            1, min_match=match, strategy=cls.STRATEGY, hash_log=12, chain_log=12, window_log=16, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def features(self, text: str | None, size: int = WINDOW) -> np.ndarray:
        """One; then for each length of a match of the windows' distances: the sum, how many there are, the sum a
        window, the largest, and whether there is any; sums as logarithms too."""
        words = (text or "").lower().encode().split()
        windows = [b" " + b" ".join(words[at : at + size]) + b" " for at in range(0, len(words), size)]
        out = [1.0]
        for ordinary, toxic in self.pairs:
            d = np.maximum(np.array([len(ordinary(x)) - len(toxic(x)) for x in windows] or [0], float), 0)
            total = d.sum()
            each = total / max(1.0, len(words) / size)
            out += [np.log1p(total), np.log1p((d > 0).sum()), each, np.log1p(each), np.log1p(d.max()), float(total > 0)]
        return np.array(out)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
    return w


def fit(rows: list[tuple[int, str]], share: float) -> Model:
    """From (label, text) in a fixed order; ``share`` is the toxic share among all rows of the fit."""
    by = [[t for y, t in rows if y == k] for k in (0, 1)]
    if min(map(len, by)) < 4:
        return b"", b"", [-30.0, *[0.0] * 6 * len(MATCHES)]
    folds = [Distance(*dictionaries(by[1][k::2], by[0][k::2])) for k in (0, 1)]
    left = [(k, folds[1 - at % 2].features(t)) for k in (0, 1) for at, t in enumerate(by[k])]  # under the other fold's dictionaries
    x, y = np.array([f for _, f in left]), np.array([k for k, _ in left], float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return *dictionaries(by[1], by[0]), calibrate(x, y, weight).tolist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From at most ``sample`` labelled rows of each class, none held out, in one task; dictionaries and curve come back."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").filter(~held_out(F.col("_id"))).distinct()
    n = {r["_y"]: r["n"] for r in ids.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = None
    for y in (0, 1):
        part = ids.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        some = part if some is None else some.unionAll(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter("_t is not null").join(F.broadcast(some), "_id").select(F.col("_id").cast("string"), "_y", "_t")
    share = n.get(1, 0) / max(1, sum(n.values()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        rows = [rows[k] for k in np.random.default_rng(2).permutation(len(rows))]
        toxic, ordinary, curve = fit([(y, t) for _, y, t in rows], share)
        yield pa.RecordBatch.from_arrays([pa.array([toxic], pa.binary()), pa.array([ordinary], pa.binary()), pa.array([curve], pa.list_(pa.float64()))], names=["toxic", "ordinary", "curve"])

    got = texts.repartition(1).mapInArrow(learn, "toxic binary, ordinary binary, curve array<double>").first()
    return (bytes(got["toxic"]), bytes(got["ordinary"]), list(got["curve"])) if got else fit([], 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, distance (bytes saved a window)."""
    toxic, ordinary, curve = model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, w = Distance(toxic, ordinary), np.array(curve)
        for batch in chunks(batches):
            x = np.array([distance.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x[:, 3])], names=["doc_id", "score", "distance"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double, distance double")
