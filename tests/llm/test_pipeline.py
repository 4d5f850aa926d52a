"""The whole pipeline on 60 documents against plain versions of its five stages, each on what the one before left."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftline.llm import mixing, quality, secrets
from weftline.llm.common import unit_interval

from test_text_operators import plain_raking

SF = "/root/testdata/sf0.01"


def good(text, model):
    """The quality stage's verdict: base rules, then the hashed features one by one."""
    import xxhash

    weights, bias, slope, intercept = model
    most, size = 2**64, 1 << quality.BITS
    slot = lambda h: h >> (64 - quality.BITS)

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % most
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB % most
        return h ^ (h >> 31)

    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(marked) > 50 * len(words):
        return 0.0
    h, p = [xxhash.xxh3_64_intdigest(w) for w in words], [ord(c) for c in text]
    total = sum(weights[slot(x)] for x in h) + len(marked) * weights[slot(mix(0x5EED))] + sum(weights[size + slot(mix((3 * a + b) % most))] for a, b in zip(h, h[1:]))
    four = sum(weights[2 * size + slot((((p[k] * 1_000_003 + p[k + 1]) * 1_000_003 + p[k + 2]) * 1_000_003 + p[k + 3]) * 0x9E3779B97F4A7C15 % most)] for k in range(len(p) - 3))
    margin = slope * (bias + total / max(1, len(words)) + four / max(1, len(p) - 3)) + intercept
    return 1 / (1 + math.exp(-margin))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def smallest(rows):
    """Ids of the rows that are the smallest of what they reach by links."""
    sets, root = {r["doc_id"]: shingles(r["text"]) for r in rows}, {r["doc_id"]: r["doc_id"] for r in rows}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                    root[a] = root[b] = min(root[a], root[b])
    return {x for x in ids if root[x] == x}


def redacted(text, table):
    """Spans found by the patterns and the two models' ratio, one by one, give way to a mark."""
    size = len(secrets.ALPHABET) + 1

    def score(run):
        total = before = 0
        for c in run:
            k = secrets.ALPHABET.find(c) + 1
            total, before = total + table[before * size + k], k
        return total

    found = []
    for k, rx in enumerate([secrets.ASSIGN, r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]):
        found += [m.span() for m in re.finditer(rx, text) if ((len(m[2]) >= 12) if k == 0 else len(m[0]) >= (18, 16)[k - 1])]
    found += [m.span() for m in re.finditer(secrets.RUN, text) if score(m[0]) >= max(secrets.LEAST_TOTAL, secrets.LEAST_EACH * len(m[0])) and not any(s < m.end() and e > m.start() for s, e in found)]
    out, at = "", 0
    for s, e in sorted(found):
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


def form(text, n):
    share = lambda chars: sum(c in chars for c in text) / max(1, len(text))
    if n == 0:
        return "empty"
    if share("#*$%&|<>{}[]=") > 0.02:
        return "markup"
    if share("0123456789") > 0.05:
        return "numbers"
    if share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3:
        return "capitals"
    return "short prose" if n < 100 else "prose" if n < 1000 else "long prose"


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    some = docs.filter("length(text) < 6000").orderBy("doc_id").limit(48)
    copies = some.filter("length(text) > 800").orderBy("doc_id").limit(12).withColumns({"doc_id": F.col("doc_id") + 5000, "text": F.concat("text", F.lit(" end."))})
    made = some.unionAll(copies).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" password: hunter2hunter2 and ya29a0AfH6SMBx7Jk2QpLmN9vR"))).otherwise(F.col("text")))
    made.write.parquet(f"{tmp_path}/documents.parquet")
    # the model is fitted on these documents' labels: every document gets one, so that there are both
    judged = made.select("doc_id", F.when(F.col("doc_id") % 7 == 3, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    judged.write.parquet(f"{tmp_path}/labels.parquet")
    made, judged = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert made.count() == 60

    rows = [r.asDict() for r in made.collect()]
    model = quality.train(made, judged)
    p = {r["doc_id"]: good(r["text"], model) for r in rows}
    assert all(abs(x - quality.KEEP) > 1e-4 for x in p.values())
    rows = [r for r in rows if p[r["doc_id"]] >= quality.KEEP]
    assert 20 < len(rows) < 60
    alone = smallest(rows)
    assert len(alone) < len(rows)
    rows = [r for r in rows if r["doc_id"] in alone]
    table = list(map(int, secrets.train(secrets.default_samples(spark)).split(",")))
    before = [r["text"] for r in rows]
    rows = [{**r, "text": redacted(r["text"], table)} for r in rows]
    assert [r["text"] for r in rows] != before

    tokens = {r["doc_id"]: len(r["text"].encode().split()) for r in rows}
    cells = pd.DataFrame([(r["source"] or "", r["lang"] or "", form(r["text"], tokens[r["doc_id"]]), tokens[r["doc_id"]]) for r in rows], columns=[*mixing.DIMENSIONS, "_tokens"])
    chance = dict(zip([r["doc_id"] for r in rows], cells.merge(plain_raking(cells, 0.5, 8_000), on=list(mixing.DIMENSIONS), how="left")["probability"]))
    drawn = {r.doc_id: r.u for r in made.select("doc_id", unit_interval(F.col("doc_id"), F.lit(7)).alias("u")).collect()}
    near = {d for d, x in chance.items() if abs(drawn[d] - x) < 5e-3}  # as near as raking settles
    taken = {d for d, x in chance.items() if drawn[d] < x}
    assert len(near) <= 2 and taken

    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for r in rows:
        if r["doc_id"] in taken - near:
            ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 1]
            want |= {(r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) - near == taken - near
    assert {x for x in zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32) if x[0] not in near} == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 4096
