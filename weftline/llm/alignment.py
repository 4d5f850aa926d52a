"""Cross-tokenizer alignment by elementary intervals.

Two tokenizers cut the same bytes.  The union of both arrays of token ends cuts them into elementary
intervals; the owner of an interval in either array is found by binary search, and every interval is
one overlap of a token of A with a token of B.  Ends in both arrays close groups of tokens.

No token of either tokenizer holds white space behind other characters, and neither looks across the
place before a run of white space.  A text is thus cut there into chunks (a run of blanks and what
follows); chunks are aligned once, in batches, and kept with their counts, links and groups.  Texts
with control characters or other kinds of white space, where that does not hold, are one chunk each.

Links are counted over the corpus by id pair, summed in each task before the shuffle.  While that
table, whose rows are counted first, has at most ``BROADCAST`` rows, it is broadcast and each chunk's
links are looked up in it; a larger one is joined with the documents' pairs.

Cases: a null or empty text, or one that a tokenizer does not give back byte for byte, has no tokens:
zeros and an empty string; repeated rows are answered and counted each; an empty table gives no rows;
special tokens' strings are ordinary text; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import chunks, durable

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rows of counts (id pairs) that may be broadcast; more are joined by a shuffle.
BROADCAST = 2_000_000
#: Chunks and bytes of chunks that a Python worker keeps.
KEPT, KEPT_BYTES = 800_000, 64_000_000
#: Chunks that are encoded in one run.
RUN = 2000
#: The pattern of A's pre-tokens (a fixed value of byte-level vocabularies of this kind).
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How B's pieces show a blank.
BLANK = chr(0x2581)
PAIR_SIZE = 1 << 20  # a pair of ids as one number: a * PAIR_SIZE + b
CHUNK = re.compile(r"[ \t\n]+[^ \t\n]*")
#: Characters that either tokenizer may treat as white space, or change, in other ways than those of CHUNK.
ODD_RANGES = [(0x00, 0x08), (0x0B, 0x1F), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
ODD = re.compile("[" + "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in ODD_RANGES) + "]")


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, their owners in a and in b, and the ends that both share."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), np.intersect1d(ends_a, ends_b, assume_unique=True)


def _path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Pair:
    """Both tokenizers, with the bytes of every id.  A's merges run in tiktoken, on the vocabulary and in the order of its file."""

    def __init__(self, name_a: str, name_b: str):
        import sentencepiece
        import tiktoken

        with open(_path(name_a), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
        rest = [x for x in range(256) if x not in shown]
        byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if all(c in byte_of for c in token) and not (token.startswith("<|") and token.endswith("|>"))}
        self.a = tiktoken.Encoding(name_a, pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(name_b))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_a[k] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], "i8") for t in (self.bytes_a, self.bytes_b))
        self.digits = np.array([len(str(k)) for k in range(max(len(self.bytes_a), len(self.bytes_b)))], "i8")
        self.said = {end: np.array([f"{k}{end}" for k in range(len(self.digits))], object) for end in ",|;"}

    def encode(self, runs: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both for strings that begin with a blank, and whether both give back the string."""
        a = [np.array(self.a.encode_ordinary(s), "i8") for s in runs]
        b = [np.array(x, "i8") for x in self.b.encode([s[1:] for s in runs], num_threads=1)]  # which puts a blank before each
        b = [x if s != " " else np.array([self.b.piece_to_id(BLANK)]) for s, x in zip(runs, b)]
        join = lambda table, ids: b"".join(map(table.__getitem__, ids.tolist()))
        return a, b, np.array([join(self.bytes_a, x) == s.encode() == join(self.bytes_b, y) for s, x, y in zip(runs, a, b)], bool)


class Aligned:
    """chunk -> its number, and by number: tokens, groups, links (as ranges of ``pairs``) and the groups as text."""

    def __init__(self, name_a: str, name_b: str):
        self.both, self.kept_chunks, self.kept_bytes = Pair(name_a, name_b), KEPT, KEPT_BYTES
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.figures = {k: array("q") for k in ("a", "b", "groups", "links", "bad")}
        self.start, self.pairs, self.size = array("q", [0]), array("q"), 0
        self.weights: tuple = ()

    def add(self, parts: list[str]) -> None:
        """Aligns new chunks, all on one axis of bytes.  Chunks that end in other characters than white
        space are encoded in runs, as nothing looks across the places between them."""
        both = self.both
        plain = [s for s in parts if not ODD.search(s) and s[-1] not in " \t\n"]
        alone = [s for s in parts if ODD.search(s) or s[-1] in " \t\n"]
        # the blank that begins a run, with the letter after it, is a chunk of its own
        runs = [[" a", *plain[k : k + RUN]] for k in range(0, len(plain), RUN)]
        runs += [[s] if s[0] == " " else [" a", s] for s in alone]
        if not runs:
            return
        ids_a, ids_b, fine = both.encode(["".join(r) for r in runs])
        for r, ok in zip(runs, fine.tolist()):
            if not ok and len(r) > 2:
                raise ValueError("a run without odd characters is not given back")
        for s in (s for r, ok in zip(runs, fine.tolist()) if not ok for s in r[-1:]):
            self.put([s], [""], np.array([[0, 0, 0, 0, 1]]), np.zeros(0, "i8"))
        good = np.flatnonzero(fine)
        if not len(good):
            return
        flat_a, flat_b = (np.concatenate([ids[k] for k in good]) for ids in (ids_a, ids_b))
        names = [s for k in good for s in runs[k]]
        ends_a, ends_b = np.cumsum(both.len_a[flat_a]), np.cumsum(both.len_b[flat_b])
        ends, own_a, own_b, shared = elementary(ends_a, ends_b)
        closed = np.cumsum([len(s.encode()) for s in names])
        upto = lambda x: np.diff(np.searchsorted(x, closed, "right"), prepend=0)
        figures = np.stack([upto(ends_a), upto(ends_b), upto(shared), upto(ends), np.zeros(len(names), "i8")], 1)
        # groups as text: A's tokens of a group, then B's, every token with the character behind it
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        said = both.said[","][np.concatenate([flat_a, flat_b])]
        last_a, last_b = np.isin(ends_a, shared), np.isin(ends_b, shared)
        said[: len(flat_a)][last_a] = both.said["|"][flat_a[last_a]]
        said[len(flat_a) :][last_b] = both.said[";"][flat_b[last_b]]
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        whole = "".join(said[order].tolist())
        stop = np.cumsum(np.bincount(group_a, both.digits[flat_a] + 1, len(shared)) + np.bincount(group_b, both.digits[flat_b] + 1, len(shared))).astype("i8")
        stop = stop[np.cumsum(figures[:, 2]) - 1].tolist()
        texts = [whole[x : y - 1] for x, y in zip([0, *stop], stop)]
        self.put(names, texts, figures, flat_a[own_a] * PAIR_SIZE + flat_b[own_b])

    def put(self, names: list[str], texts: list[str], figures: np.ndarray, pairs: np.ndarray) -> None:
        self.number.update(zip(names, range(len(self.text), len(self.text) + len(names))))
        self.text += texts
        self.size += sum(map(len, names))
        for name, x in zip(self.figures, np.ascontiguousarray(figures.T, "i8")):
            self.figures[name].frombytes(x.tobytes())
        self.start.frombytes((self.start[-1] + np.cumsum(figures[:, 3], dtype="i8")).tobytes())
        self.pairs.frombytes(pairs.astype("i8").tobytes())

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks of the texts, and where each text's begin (and the last one's end)."""
        if len(self.text) > self.kept_chunks or self.size > self.kept_bytes:
            self.clear()
        parts = []
        for t in texts:
            s = " " + t.decode() if t else ""
            parts.append([s] if ODD.search(s) else CHUNK.findall(s))
        self.add(list({s for p in parts for s in p}.difference(self.number)))
        self.now = np.array(self.start, "i8"), np.array(self.pairs, "i8")
        firsts = np.cumsum([0, *map(len, parts)])
        get = self.number.__getitem__
        return np.fromiter((x for p in parts for x in map(get, p)), "i8", int(firsts[-1])), firsts

    def of(self, name: str) -> np.ndarray:
        return np.array(self.figures[name], "i8")

    def sums(self, name: str, numbers: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """A figure's sum for each text."""
        return summed(self.of(name)[numbers], firsts)

    def links(self, numbers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs of chunks that occur ``times`` times, and their links."""
        start, pairs = self.now
        n = start[numbers + 1] - start[numbers]
        at = np.repeat(start[numbers] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        got, inverse = np.unique(pairs[at], return_inverse=True)
        return got, np.bincount(inverse, np.repeat(times, n), len(got)).astype("i8")

    def weighted(self, key: str, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's sum of its links' counts, and its links whose pair is best; kept until chunks come or go."""
        done, n_best, n_sum = (len(self.weights[1]), *self.weights[1:]) if self.weights and self.weights[0] == key else (0, np.zeros(0, "i8"), np.zeros(0, "i8"))
        if done < len(self.text):
            start = np.array(self.start, "i8")[done:]
            pairs = np.array(self.pairs, "i8")[start[0] :]
            at = np.searchsorted(table[0], pairs)
            known = np.append(table[0], -1)[at] == pairs  # a worker also keeps chunks of other texts
            n_best = np.append(n_best, summed(np.where(known, np.append(table[2], False)[at], False).astype("i8"), start - start[0]))
            n_sum = np.append(n_sum, summed(np.where(known, np.append(table[1], 0)[at], 0), start - start[0]))
            self.weights = (key, n_best, n_sum)
        return n_best, n_sum


def summed(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the ranges of x that begin at ``firsts``, the last of which ends them."""
    total = np.append(0, np.cumsum(x))
    return np.diff(total[firsts])


_aligned: dict[tuple[str, str], Aligned] = {}


def _tool(a: str, b: str) -> Aligned:
    return _aligned.get((a, b)) or _aligned.setdefault((a, b), Aligned(a, b))


def pair_counts(docs: DataFrame, text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """(a, b, n, best): links between two ids over the corpus; best where no other a has more with that b."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(a, b)
        total = np.zeros((2, 0), "i8")

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total[0] // PAIR_SIZE), pa.array(total[0] % PAIR_SIZE), pa.array(total[1])], names=["a", "b", "n"])

        for batch in chunks(batches):
            numbers, firsts = tool.numbers(batch.column(0).to_pylist())
            numbers = numbers[np.repeat(tool.sums("bad", numbers, firsts) == 0, np.diff(firsts))]
            own, times = np.unique(numbers, return_counts=True)
            pairs, n = tool.links(own, times)
            both, inverse = np.unique(np.append(total[0], pairs), return_inverse=True)
            total = np.array([both, np.bincount(inverse, np.append(total[1], n), len(both)).astype("i8")]).reshape(2, -1)
            if total.shape[1] > 1_000_000:
                yield out()
                total = np.zeros((2, 0), "i8")
        yield out()

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(work, "a long, b long, n long")
    n = rows.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, counts=None) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, groups_sha256; with ``counts``, a broadcast of
    (pairs in order, n, best), n_best and count_sum; else its distinct id pairs with their links."""
    lists = [pa.list_(pa.int64())] * 2 if counts is None else [pa.int64()] * 2
    run = uuid.uuid4().hex  # names the table of counts in the workers
    last = ["pairs", "times"] if counts is None else ["n_best", "count_sum"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(a, b)
        for batch in chunks(batches):
            numbers, firsts = tool.numbers(batch.column(1).to_pylist())
            fine = (tool.sums("bad", numbers, firsts) == 0) & (np.diff(firsts) > 0)
            out = [np.where(fine, tool.sums(k, numbers, firsts), 0) for k in ("a", "b", "groups", "links")]
            each = [numbers[x:y] if ok else numbers[:0] for x, y, ok in zip(firsts, firsts[1:], fine)]
            said = [hashlib.sha256(";".join(map(tool.text.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in each]
            if counts is None:
                more = list(zip(*[tool.links(*np.unique(x, return_counts=True)) for x in each])) or [(), ()]
            else:
                more = [np.where(fine, summed(x[numbers], firsts), 0) for x in tool.weighted(run, counts.value)]
            cols = [batch.column(0), *map(pa.array, out), pa.array(said, pa.string()), *[pa.array(c, t) for c, t in zip(more, lists)]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *last])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind_of_id, kind = rows.schema["doc_id"].dataType.simpleString(), "array<long>" if counts is None else "long"
    return rows.mapInArrow(work, f"doc_id {kind_of_id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {last[0]} {kind}, {last[1]} {kind}")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, broadcast: int = BROADCAST) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    counts = durable(pair_counts(docs, text_col, a, b).select((F.col("a") * PAIR_SIZE + F.col("b")).alias("_pair"), F.col("n").alias("_n"), F.col("best").alias("_best")))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if counts.count() <= broadcast:
        got = counts.toArrow()
        order = np.argsort(pairs := got["_pair"].to_numpy())
        sent = docs.sparkSession.sparkContext.broadcast((pairs[order], got["_n"].to_numpy()[order], got["_best"].to_numpy()[order]))
        return tokens(docs, id_col, text_col, a, b, sent).select(*own, "n_best", "count_sum", "groups_sha256")
    rows, own = tokens(docs, id_col, text_col, a, b).withColumn("_row", F.monotonically_increasing_id()), ["_row", *own, "groups_sha256"]
    each = rows.select(*own, F.explode_outer(F.arrays_zip("pairs", "times")).alias("_x")).select(*own, F.col("_x.pairs").alias("_pair"), F.col("_x.times").alias("_t"))
    joined = each.join(counts, "_pair", "left").groupBy(*own).agg(F.coalesce(F.sum(F.when(F.col("_best"), F.col("_t"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("_t") * F.col("_n")), F.lit(0)).alias("count_sum"))
    return joined.select(*own[1:-1], "n_best", "count_sum", "groups_sha256")
