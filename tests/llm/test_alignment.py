"""Cross-tokenizer alignment against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import alignment, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.TOKENIZER_B)), alignment.Pair(alignment.TOKENIZER_A, alignment.TOKENIZER_B)


def plain(text, tools):
    """(tokens of a, tokens of b, groups, links as id pairs, groups as text) by walking both token lists."""
    a, b, both = tools
    none = (0, 0, 0, [], "")
    if not text:
        return none
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a, raw_b = [both.bytes_a[x] for x in ids_a], [both.bytes_b[x] for x in ids_b]
    if not b"".join(raw_a) == (" " + text).encode() == b"".join(raw_b):
        return none
    links, said, i, j, i0, j0, left_a, left_b = [], [], 0, 0, 0, 0, len(raw_a[0]), len(raw_b[0])
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        n = min(left_a, left_b)
        left_a, left_b = left_a - n, left_b - n
        ended = not left_a and not left_b
        if not left_a:
            i += 1
            left_a = len(raw_a[i]) if i < len(ids_a) else 0
        if not left_b:
            j += 1
            left_b = len(raw_b[j]) if j < len(ids_b) else 0
        if ended:
            said.append(",".join(map(str, ids_a[i0:i])) + "|" + ",".join(map(str, ids_b[j0:j])))
            i0, j0 = i, j
    return len(ids_a), len(ids_b), len(said), links, ";".join(said)


def answers(rows, tools):
    got = [(r.doc_id, *plain(r.text, tools)) for r in rows]
    counts = Counter(x for r in got for x in r[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((d, a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if a else "") for d, a, b, g, links, s in got)


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST, 0])
def test_alignment_against_loops(spark, tools, broadcast):
    odd = [(9001, None), (9002, ""), (9003, " "), (9003, " "), (9004, "  a\n\n b \t"), (9005, "<|endoftext|> <s></s><0x41>"), (9006, "x" + chr(0x2581) + "y"), (9007, "a\r\n\x0b" + chr(0xA0) + " b"), (9008, "\U0001f600 caf\u00e9 \u6f22\u5b57 \ufb01"), (9009, "long " * 40000 + "x" * 5000), (9010, "\n"), (9011, "a\x00b")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({"n_a": F.lit(1), "_row": F.lit("x"), "_pair": F.lit(0)})
    got = alignment.align(docs, broadcast=broadcast)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, got.collect())) == answers(docs.collect(), tools)


def test_random_strings(tools):
    tool, r = alignment.Aligned(alignment.TOKENIZER_A, alignment.TOKENIZER_B), random.Random(1)
    tool.kept_chunks = 500  # chunks are forgotten on the way
    pool = [*"abXY \n\n\t\r'.,!<|>s0129", "  ", "<|endoftext|>", " the", "'s", *map(chr, (0xE9, 0xA0, 0x85, 0x2009, 0x2581, 0x3000, 0x6F22, 0x1F600, 0xFB01, 0x301, 0x200B))]
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 30)))
        numbers, firsts = tool.numbers([text.encode()])
        a, b, groups, links, said = plain(text, tools)
        fine = len(numbers) and not tool.sums("bad", numbers, firsts)[0]
        assert (";".join(tool.text[x] for x in numbers) if fine else "") == said, repr(text)
        assert not fine or [int(tool.sums(k, numbers, firsts)[0]) for k in ("a", "b", "groups", "links")] == [a, b, groups, len(links)]


def test_chunks_kept_of_other_texts():
    tool = alignment.Aligned(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    for t in (b"zebra quilts", b"Aardvark"):
        tool.numbers([t])
    numbers, _ = tool.numbers([b"a b a"])
    pairs, n = tool.links(*np.unique(numbers, return_counts=True))
    n_best, n_sum = tool.weighted("run", (pairs, n, np.ones(len(n), bool)))
    assert (n_best[numbers].sum(), n_sum[numbers].sum()) == (n.sum(), (n * n).sum())
    none = np.zeros(0, "i8")
    assert [x.sum() for x in tool.weighted("none", (none, none, none.astype(bool)))] == [0, 0]


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, tools):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, queries.op13_alignment(spark, SF).collect())) == answers(docs.collect(), tools)
