"""Best-fit packing: bounded-space online best-fit, with open bins in a bitset keyed by free space.

Texts become token ids in Arrow batches; only texts longer than a sequence are cut.  Pieces are
dealt by a hash into buckets of bounded size, and every bucket packs its pieces one after the
other: each goes to the open bin with least free space that holds it (the lowest set bit at or
above its length); when all bins are open and none fits, the fullest one closes.

Cases: a null text is the empty text and gives one piece, the end token; texts of any length give
as many pieces as they need; repeated rows are packed as often as they occur; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, durable

VOCABULARY = "word_bpe_49k.json"
#: Pieces that one task packs.
BUCKET = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The tokenizer's pattern of pre-tokens (a fixed value of its file) for lower-case Latin-1 words, and the line ends between them.
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\n0-9²³¹¼½¾a-zªµºß-öø-ÿ]+|\n"
#: What the vocabulary puts behind a token that ends a pre-token (fixed too).
SUFFIX = "</w>"


def ranks(name: str) -> dict[bytes, int]:
    """Each token's bytes, a blank behind those that end a pre-token, and its id."""
    with open(name, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
    rest = [x for x in range(256) if x not in shown]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}
    return {bytes(byte_of[c] for c in token.removesuffix(SUFFIX)) + b" " * token.endswith(SUFFIX): k for token, k in vocabulary.items()}


class Ids:
    """Token ids of texts.

    The tokenizer drops white space and never joins across it, so that a text's ids are those of
    its words; each word of a batch is encoded once, and nothing is kept from batch to batch.  Plain
    Latin words are split into pre-tokens here, whose merges run in tiktoken on the file's
    vocabulary; any other word goes to the tokenizer whole.  A blank stands for the suffix of a
    pre-token's end, and the file's ids are in the order of its merges, so that they are tiktoken's
    ranks.  tiktoken merges any two neighbours that make a token, the tokenizer only the pair of a
    merge; that is the same where the merges, let loose on each token's own symbols, give back this
    token (a test holds it), as neighbours that make a token have come about from its symbols alone.
    """

    def __init__(self, name: str):
        import tiktoken
        from tokenizers import Tokenizer

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.whole = Tokenizer.from_file(name)
        self.special = sorted(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.merged = tiktoken.Encoding(name, pat_str="[^ ]+ ", mergeable_ranks=ranks(name), special_tokens={}).encode_ordinary
        self.plain, self.split = re.compile(r"[\n\x21-\x7e¡-ÿ]*"), re.compile(LATIN)

    def is_plain(self, s: str) -> bool:
        """Whether words (between line ends) are Latin-1 and hold no string of a special token, whose id is that token's."""
        return self.plain.fullmatch(s) is not None and not any(x in s for x in self.special)

    def of_words(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (one a line), one word's behind the other's, and the place where each word's end."""
        odd = {}
        if not self.is_plain(lines):
            words = lines.split("\n")
            for k, s in enumerate(words):
                if not self.is_plain(s):
                    odd[k], words[k] = self.whole.encode(s, add_special_tokens=False).ids, ""
            lines = "\n".join(words)
        ids = np.array(self.merged(" ".join(self.split.findall(f"\n{lines}\n".lower())) + " "), "<u4")
        is_end = ids == ids[0]  # a line's end is before the first word and behind each
        ends = np.flatnonzero(is_end)
        ends = ends[1:] - np.arange(1, len(ends))
        ids = ids[~is_end]
        if odd:
            ids = np.insert(ids, np.repeat(ends[list(odd)], [len(x) for x in odd.values()]), np.array(list(chain.from_iterable(odd.values())), "<u4"))
            more = np.zeros(len(ends), "i8")
            more[list(odd)] = [len(x) for x in odd.values()]
            ends = ends + more.cumsum()
        return ids, ends

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, ``end_id`` behind each text's, and the place where each text's end."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")
        ids, ends = self.of_words(lines[0].as_py())
        ids, ends = np.append(ids, np.array([end_id], "<u4")), np.append(ends, len(ids) + 1)
        last = words.value_lengths().to_numpy().cumsum()
        codes = np.insert(coded.indices.to_numpy(), last, len(ends) - 1)  # the end token is one more word
        lengths = np.diff(ends, prepend=0)
        size = lengths[codes]
        upto = size.cumsum()
        places = np.repeat((ends - lengths)[codes] - (upto - size), size)
        places += np.arange(len(places))
        return ids[places], upto[last + np.arange(len(last))]


_ids: dict[str, Ids] = {}


def cut(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens, ``end_id`` behind each text's own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = _ids.get(tokenizer) or _ids.setdefault(tokenizer, Ids(tokenizer))
        for batch in chunks(batches, 8_000_000):
            out: list[tuple] = []
            got, ends = ids.encode(batch.column(1), end_id)
            for doc, first, last in zip(batch.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                for k, at in enumerate(range(first, last, capacity)):
                    piece = got[at : min(at + capacity, last)]
                    out.append((doc, k, at - first, len(piece), zlib.crc32(piece)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, PIECES)


def best_fit(lengths: list[int], capacity: int, bins: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each piece, in the order given."""
    free_of: dict[int, list[int]] = defaultdict(list)  # free space -> open bins
    bits = count = opened = 0
    where, offset = [], []
    for n in lengths:
        at = bits >> n
        if at:
            free = n + (at & -at).bit_length() - 1
            b = free_of[free].pop()
            if not free_of[free]:
                bits ^= 1 << free
            opened -= 1
        else:
            if opened >= bins and n < capacity:
                free = (bits & -bits).bit_length() - 1  # the fullest closes
                free_of[free].pop()
                if not free_of[free]:
                    bits ^= 1 << free
                opened -= 1
            free, b, count = capacity, count, count + 1
        where.append(b)
        offset.append(capacity - free)
        if free := free - n:
            free_of[free].append(b)
            bits |= 1 << free
            opened += 1
    return where, offset


def pack(pieces: DataFrame, capacity: int = 4096, bins: int = 1024, bucket: int = BUCKET) -> DataFrame:
    """Adds sequence_id and offset to pieces (see ``cut``)."""
    pieces = durable(pieces)
    buckets = max(1, math.ceil(pieces.count() / bucket))
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("long"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_h=pd.util.hash_array(pdf["doc_id"].fillna(-1).to_numpy("int64")) % 1009).sort_values(["_h", "doc_id", "piece", "ids_crc32", "length"], kind="stable")
        where, offset = best_fit(pdf["length"].tolist(), capacity, bins)
        pdf["sequence_id"] = pdf["_b"].iloc[0] * (1 << 32) + np.array(where, "int64")
        pdf["offset"] = np.array(offset, "int64")
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return dealt.groupBy("_b").applyInPandas(work, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = VOCABULARY, bins: int = 1024) -> DataFrame:
    return pack(cut(docs, capacity, end_id, tokenizer), capacity, bins)
