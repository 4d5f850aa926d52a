"""Conversation repair against a plain search over whole audits."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from weftline.llm import conversations as conv


sys.setrecursionlimit(20_000)


def best(rows):
    """(cost, audit) of rows (initial, fault): the least, searched from the front over whole endings."""

    @lru_cache(maxsize=None)
    def go(k, state, inserts):
        ways = [(0, "")] if k == len(rows) and state in "0a" else []
        if inserts < 3:
            cost, rest = go(k, "a" if state == "u" else "u", inserts + 1) or (None, None)
            ways += [(cost + 2, "I" + rest)] if rest is not None else []
        if k < len(rows):
            initial, fault = rows[k]
            moves = [(3, "D", state)]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if initial and initial in {"0": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    moves.append((late, "K", initial))
                moves += [(2 + late, "R", x) for x in {"0": "u", "s": "u", "u": "a", "a": "u"}[state]]
            for cost, letter, to in moves:
                if got := go(k + 1, to, 0):
                    ways.append((cost + got[0], letter + got[1]))
        return min(ways, default=None)

    return go(0, "0", 0)


def plain(table):
    out = {}
    for c, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(c, [])
        if x:
            text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            own += [(turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    res = []
    for c, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", None), 0)
        for _, role, text in own:
            shown = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            rows.append((role[:1], fault))
        cost, audit = best(tuple(rows))
        kept, k = [], 0
        for letter in audit:
            before = kept[-1][0][:1] if kept else ""
            role, text = ("", "") if letter == "I" else own[k][1:]
            k += letter != "I"
            if letter != "D":
                kept.append((role if letter == "K" else "assistant" if before == "u" else "user", text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(rows[k][0] + rows[k + 1][0] not in ("su", "ua", "au") for k in range(len(rows) - 1))
        res.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(res, key=repr)


def made(n, seed):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "user", "assistant", "", None, "Sys"], ["One. ", "two", "Three!", "?", " \t", "", None, "four.\n", "a\u00a0"]
    return [(c, r.choice([None, r.randint(-2, 9), t]), r.choice(roles), r.choice(texts)) for c in range(n) for t in range(r.randint(1, 9))]


@pytest.mark.parametrize("part_bits", [conv.PART_BITS, 1])
def test_repair_against_search(spark, part_bits):
    table = made(300, 5) + [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 4, "assistant", "No.")] + [(1000, k, ("user", "assistant", "system")[k * k % 3], f"{k % 17}{'.' * (k % 5 > 0)}") for k in range(250)] + [(1001, 7, "user", "Same.")] * 40 + [(1002, 1, "user", "Long " * 100000 + ".")]
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit("x"), "_k": F.lit(1), "code": F.lit(2)})
    got = conv.repair_damaged(rows.repartition(7), part_bits)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted(map(tuple, got.collect()), key=repr) == plain(table)


def test_matrices_fold_as_whole_strings():
    r = random.Random(2)
    for _ in range(300):
        codes = "".join(r.choice(conv.CLASSES) for _ in range(r.randint(0, 14)))
        f, at = conv.Fold(), 0
        while at < len(codes):
            n = r.randint(1, 4)
            part = codes[at : at + n]
            said = conv.initials(part)
            f.add(at, list(conv.matrix(part)), conv.illegal(said), said[0] + said[-1])
            at += n
        cost, parts = f.end()
        rows = tuple(("sua\n"[conv.CLASSES.index(c) // 3], (None, "blank", "truncated")[conv.CLASSES.index(c) % 3]) for c in codes)
        assert (cost, "".join(parts)) == best(rows)
        assert f.illegal == conv.illegal(conv.initials(codes))


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Why?"), (2, 0, "user", "Go."), (3, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, conv.repaired(rows).collect()))
    assert got == [(1, 0, "system", "Be kind.", "K"), (1, 1, "user", "", "I"), (1, 2, "assistant", "Hello.", "K"), (1, 3, "user", "Why?", "K"), (1, 4, "assistant", "", "I"), (2, 0, "user", "Go.", "K"), (2, 1, "assistant", "", "I")]


def test_empty(spark):
    assert conv.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
