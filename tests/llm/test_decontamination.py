"""Benchmark decontamination against plain loops."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import decontamination as deco

SF = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, window):
    own = [(k, words(t)) for k, t in items]
    own = [(k, w, min(window, len(w))) for k, w in own if w]
    places = {}
    for k, w, n in own:
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {n for _, _, n in own}:
            for i in range(len(w) - n + 1):
                if x := places.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = items[3][1]
    docs += [(9001, None), (9002, ""), (9003, long.upper()), (9003, long.upper()), (9004, f"x{long}! " * 300), (9005, "Tiny, item"), (9006, "tiny item tiny item"), (9007, "caf\u00e9 \u6f22\u5b57 one"), (9008, " ".join(words(long)[5:14])), (9009, "word " * 50000 + long)]
    items += [(800, None), (801, " .,"), (802, "tiny item"), (803, "TINY item"), (804, long), (805, "caf\u00e9 \u6f22\u5b57"), (None, "tiny")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_row": F.lit("x"), "item_id": F.lit(0)}), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))


@pytest.mark.parametrize("how", [{}, {"shard": 3000, "block": 900}, {"window": 3, "block": 2000}, {"window": 1}])
def test_scan_against_loops(tables, how):
    docs, items, rows, bench = tables
    assert sorted(map(tuple, deco.scan(rows, bench, **how).collect()), key=repr) == plain(docs, [("" if k is None else k, t) for k, t in items], how.get("window", 10))


def test_suffix_array_and_longest(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abcde") for _ in range(n))
    for _ in range(60):
        docs, items = [text(r.randint(0, 60)) for _ in range(4)], [(k, text(r.randint(1, 20))) for k in range(4)]
        docs.append(items[0][1])
        tests = deco.Tests([(k, t.encode()) for k, t in items], 1)
        shard = deco.Shard([deco.words(t.encode()) for t in docs], tests)
        ends = [shard.words[p : p + shard.run[p]][: tests.most].tolist() for p in shard.order]
        assert ends == sorted(ends)
        n, place = shard.longest(tests)
        joined = [f" {t} " for t in docs]
        at = 0
        for _, t in items:
            w = t.split()
            for i in range(len(w)):
                best = max(k for k in range(len(w) - i + 1) if not k or any(f" {' '.join(w[i : i + k])} " in d for d in joined))
                assert n[at] == best
                assert not best or shard.words[place[at] : place[at] + best].tolist() == tests.words[at : at + best].tolist()
                at += 1


def test_longest_matches(tables):
    docs, items, rows, bench = tables
    got = {(r.item_id, r.item_at): r for r in deco.longest_matches(rows, bench, least=8, shard=5000, block=3000).collect()}
    text = {}
    for k, t in docs:
        text.setdefault(k, f" {' '.join(words(t))} ")
    for k, t in items:
        w = words(t)
        for i in range(len(w)):
            best = max([n for n in range(8, len(w) - i + 1) if any(f" {' '.join(w[i : i + n])} " in x for x in text.values())], default=0)
            assert (got[str(k), i].n_words if (str(k), i) in got else 0) == best
    one = got["3", 0]
    assert words(dict(docs)[one.doc_id])[one.doc_at : one.doc_at + one.n_words] == words(items[3][1])


def test_decontaminate(tables, spark):
    docs, items, rows, bench = tables
    kept = deco.decontaminate(rows, bench)
    assert kept.columns == rows.columns
    bad = {r[0] for r in plain(docs, items, 10) if r[5]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if k not in bad)
    assert 9003 in bad and 9008 not in bad


def test_empty(spark, tables):
    _, _, rows, bench = tables
    assert deco.scan(rows.limit(0), bench).collect() == []
    assert not any(r.contaminated or r.n_items for r in deco.scan(rows, bench.limit(0)).collect())
