import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import code, paths
from weftline.operators import clusters, graph, registers, render, tasks
from weftline.plans import registry
from weftline.sources import readers, views


def one(df):
    return df.first()[0]


def values(spark, exprs, *inputs):
    """The expression of each input."""
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string").orderBy("k").select(exprs(F.col("x"))).collect()]


def test_paths(spark):
    assert values(spark, paths.extname, "a/b.d.ts", ".x", "a/c", "a.b/c", "x.TSX") == [".ts", "", "", "", ".TSX"]
    assert values(spark, paths.dirname, "a/b/c.ts", "c.ts") == ["a/b", "."]
    assert values(spark, paths.stem, "a/b.d.ts", ".x", "c") == ["b.d", ".x", "c"]
    assert values(spark, paths.ancestors, "a/b/c.ts", "c") == [["a", "a/b"], []]
    assert values(spark, paths.path_id, "src/components/", "a//b", "", "__A__") == ["src_components", "a_b", "root", "a"]
    rows = spark.createDataFrame([(["a/b/c.ts", "a/b/d/e.ts"],), (["a.ts", "b/c.ts"],)], "p array<string>")
    assert [r[0] for r in rows.select(paths.common_directory(F.col("p"))).collect()] == ["a/b", ""]


@pytest.mark.parametrize("n, expected", [(0, "P2"), (4, "P2"), (5, "P1"), (7, "P1"), (9, "P1"), (10, "P0"), (20, "P0")])
def test_priority_by_dependents(spark, n, expected):
    df = spark.createDataFrame([("a/b.ts", "const x = 1")], "p string, c string")
    assert one(df.select(code.priority(F.col("p"), F.lit(n), F.col("c")))) == expected


def test_priority_by_name_and_content(spark):
    rows = [("a.css", "x", "P4"), ("a.test.ts", "x", "P3"), ("__tests__/a.ts", "x", "P3"), ("a.stories.tsx", "x", "P3"), ("index.ts", "x", "P0"), ("A.tsx", "<div>", "P1"), ("b.ts", "useState (", "P1"), ("c.ts", None, "P2")]
    df = spark.createDataFrame([(p, c) for p, c, _ in rows], "p string, c string")
    assert [r[0] for r in df.select(code.priority(F.col("p"), F.lit(0), F.col("c"))).collect()] == [x for *_, x in rows]


@pytest.mark.parametrize("tokens, budget", [(0, 15000), (5000, 20500), (30000, 70000), (80000, 135000), (10**7, 300000)])
def test_budget(spark, tokens, budget):
    assert one(spark.range(1).select(code.token_budget(F.lit(tokens)))) == budget


def test_names_in_code(spark):
    c = "export const A = 1\nexport default function F() {}\nexport { b, c }\nexport type T = {}\nfunction g() {}\n  function h() {}\nuseXy(1); useXy(2)\ninterface BProps {}"
    df = spark.createDataFrame([(c,)], "c string")
    got = df.select(code.exports(F.col("c")).alias("e"), code.hooks(F.col("c")).alias("h"), code.prop_types(F.col("c")).alias("p"), code.top_level_functions(F.col("c")).alias("f")).first()
    assert got.e == ["A", "F", "b", "function", "T"] and got.h == ["useXy"] and got.p == ["BProps"] and got.f == ["g"]
    assert values(spark, code.is_barrel, "export * from './a'\n// x\n'use client'", "export { a } from 'b'\nconst x = 1", "") == [True, False, True]
    name = lambda x: code.component(x.rlike(code.STRICT_JSX), code.exports(x), code.top_level_functions(x))[1]
    assert values(spark, name, "export const Foo = () => <Bar />", "const a = 1", "export type T = 1") == ["Foo", None, "T"]


def test_frontmatter_forms(spark):
    a = "---\nissueId: IS-1\ntype: bug\nsource_files: [a.ts, 'b.ts']\n---\nx"
    b = "---\r\nid: IS-2\r\nsource_files:\r\n  - a.ts\r\n  - b.ts\r\n---"
    c = "| **ID** | IS-3 |\n| **Type** | `bug` |\n| **Severity** | HIGH |\n| **Source** | z.ts |"
    df = spark.createDataFrame([(a,), (b,), (c,), ("",)], "t string")
    got = [r[0] for r in df.select(readers.parse_issue(F.col("t"))).collect()]
    assert [g.id for g in got] == ["IS-1", "IS-2", "IS-3", None]
    assert [g.source_files for g in got] == [["a.ts", "b.ts"], ["a.ts", "b.ts"], ["z.ts"], []]
    assert got[2].type == "bug" and got[2].severity == "high"


def test_changes(spark):
    df = spark.createDataFrame([("M\ta.ts",), ("A\tb.ts",), ("D\tc.ts",), ("R100\told.ts\tnew.ts",)], "value string")
    assert {tuple(r) for r in readers.name_status(df).collect()} == {("a.ts", "modified"), ("b.ts", "added"), ("c.ts", "deleted"), ("new.ts", "modified")}


def test_reachability(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(12)] + [(0, 5), (20, 21), (21, 20), (31, 30), (32, 30), (33, 31), (33, 32)], "src int, dst int")
    seeds = lambda *x: spark.createDataFrame([(k,) for k in x], "node int")
    got = lambda *x: {r.node for r in graph.affected(seeds(*x), e).collect()}
    assert got(0) == set(range(13)) and got(20) == {20, 21} and got(30) == {30, 31, 32, 33} and got(99) == {99}
    assert graph.affected(seeds(), e).count() == 0
    changes = spark.createDataFrame([(30, "deleted")], "path int, status string")
    assert {tuple(r) for r in graph.affected_with_reason(changes, e).collect()} == {(30, "Directly deleted", 0), (31, "Depends on changed file", 1), (32, "Depends on changed file", 1), (33, "Depends on changed file", 2)}
    nodes = spark.createDataFrame([(k,) for k in (0, 1, 12, 20, 21, 50)], "node int")
    assert {r.node: r.component for r in graph.components(nodes, spark.createDataFrame([(0, 1), (1, 12), (21, 20)], "src int, dst int")).collect()} == {0: 0, 1: 0, 12: 0, 20: 20, 21: 20, 50: 50}


def test_build_marks_both_ends_of_circles(spark):
    raw = spark.createDataFrame([("a", "b", "local", True, 0), ("b", "c", "local", False, 1), ("a", "react", "external", False, 2)], "src string, dst string, type string, circular boolean, ord int")
    modules, edges = graph.build(raw)
    assert {r.source: r.has_circular for r in modules.collect()} == {"a": True, "b": True, "c": False}
    assert "a --> b" in graph.mermaid(edges).replace('["a"]', "").replace('["b"]', "")


def test_dedup_keeps_the_earliest_and_names_the_keeper_of_the_moment(spark):
    rows = [(1, "k", "2024-03"), (2, "k", "2024-02"), (3, "k", "2024-05"), (4, "k", "2024-01"), (5, "m", "2024-01"), (6, "m", "2024-01")]
    df = spark.createDataFrame(rows, "id int, type string, detected_at string")
    got = {r.id: (r.is_duplicate, r.duplicate_of, r.final_keeper) for r in registers.dedup(df, ["type"]).collect()}
    assert got == {1: (True, 2, 4), 2: (True, 4, 4), 3: (True, 2, 4), 4: (False, None, 4), 5: (False, None, 5), 6: (True, 5, 5)}


def test_recheck_needs_both_for_stale(spark):
    f = spark.createDataFrame([(1, "a"), (1, "d"), (2, "a"), (3, "d"), (4, "x")], "id int, path string")
    p = lambda *x: spark.createDataFrame([(k,) for k in x], "path string")
    assert {r.id: r.action for r in registers.recheck(f, p("a"), p("d")).collect()} == {1: "stale", 2: "recheck", 3: "unchanged", 4: "unchanged"}


def test_normal_names(spark):
    assert values(spark, registers.severity_name, "P1", "Minor", "x", None) == ["high", "low", "unknown", "unknown"]
    assert values(spark, registers.type_name, "Type-Safety", None, "zz") == ["typescript", "unknown", "zz"]
    assert values(spark, registers.chapter_of, "bug", "zz") == ["ch-01-bugs", "ch-99-archived"]
    assert values(spark, registers.normal_title, "Ärger: A-b 1!") == ["ärgerab1"]
    assert values(spark, readers.csv_text, 'a"b', "x", "a,b", None) == ['"a""b"', "x", '"a,b"', ""]


def test_schedule_and_batch(spark):
    t = spark.createDataFrame([("a", 100, 0), ("b", 100, 1), ("a", 100, 2), ("c", 100, 3), ("d", 100, 4)], "id string, tokens long, ord int")
    known = spark.createDataFrame([("b", "completed", 0), ("c", "pending", 0), ("c", "failed", 1)], "id string, status string, ord int")
    got = {r.ord: (r.action, r.issue_from) for r in tasks.schedule(t, known).collect()}
    assert got == {0: ("run", 1), 1: ("skip", None), 2: ("skip", None), 3: ("retry", 11), 4: ("run", 21)}
    assert tasks.batch(t, 5, 250, ["ord"]).count() == 2 and tasks.batch(t, 5, 99, ["ord"]).count() == 0


def test_phases_and_state(tmp_path):
    assert tasks.phase_range("SCAN", "GEN") == ["SCAN", "DEPENDENCY", "GEN"] and tasks.phase_range(None, None) == [] and tasks.phase_range("GEN", "SCAN") == []
    assert tasks.phase_range("VALIDATE", None) == ["ASSEMBLE", "VALIDATE"] and tasks.phase_range("VALIDATE", "VALIDATE") == ["VALIDATE"] and tasks.phase_range(None, "SCAN") == ["INIT", "SCAN"]
    path = str(tmp_path / "state.json")
    assert readers.update_state(path, lambda x: {**x, "n": x.get("n", 0) + 1})["n"] == 1 and readers.update_state(path, lambda x: {**x, "n": x["n"] + 1})["n"] == 2
    with pytest.raises(ValueError):
        readers.update_state(path, lambda x: {**x, "schemaVersion": 9}) and readers.update_state(path, lambda x: x)
    log = [("GEN", "a b\nmore"), *[("SCAN", str(k)) for k in range(9)]]
    assert tasks.append_feedback(log, "GEN", "a\nother") == log and tasks.append_feedback(log, "SCAN", "a") == [*log, ("SCAN", "a")] and len(tasks.append_feedback([*log, ("X", "y")], "GEN", "a")) == 12
    assert render.progress_bar(1, 2, 4) == "██░░" and len(render.short("x" * 60)) == 40 and render.inject(render.inject("t", "a"), "b") == "t\n\n<!-- feedback -->\nb\n"


def test_greedy_clusters(spark):
    f = spark.createDataFrame([("A", 9000, True, False), ("B", 8000, True, False), ("x", 9000, False, False), ("y", 8000, False, False), ("u", 7000, False, False), ("bar", 10, False, True)], "path string, tokens long, is_seed boolean, is_barrel boolean")
    e = spark.createDataFrame([("A", "x"), ("x", "y"), ("B", "y"), ("B", "bar"), ("u", "B")], "src string, dst string")
    got = {(r.cluster, r.path) for r in clusters.greedy(f, e).collect()}
    assert got == {("A", "A"), ("A", "x"), ("A", "y"), ("B", "B"), ("B", "u")}
    none = f.withColumn("tokens", F.when(F.col("path") != "x", F.col("tokens")))
    assert ("A", "x", clusters.FALLBACK_TOKENS) in {tuple(r) for r in clusters.greedy(none, e).collect()}


def test_seed_clusters_over_all_edges_against_a_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    tokens = {r.doc_id: 30 * r.tokens for r in registry._ranked(spark, sf).select("doc_id", "tokens").collect()}
    out, back = {}, {}
    for r in views.edges(spark, sf).collect():
        out.setdefault(r.src, set()).add(r.dst), back.setdefault(r.dst, set()).add(r.src)
    seeds, barrels = {d for d in tokens if d % 11 == 4}, {d for d in tokens if d % 53 == 0}
    near = lambda x, shut: out.get(x, set()) - shut
    reached = {s: (near(s, barrels) | {y for x in near(s, barrels) for y in near(x, barrels)}) - {s} for s in seeds}
    shut = barrels | {d for d in tokens if sum(d in x for x in reached.values()) >= 3}
    total = spark.createDataFrame([(sum(tokens.values()),)], "t long")
    least = total.select(code.cluster_thresholds(F.col("t"))["min_tokens"]).first()[0]
    taken, want = set(), set()
    order = sorted(seeds, key=lambda s: (-tokens[s], s))
    for s in order:
        if s not in taken:
            one = near(s, shut) - taken
            own = {s} | one | {y for x in one | {s} for y in near(x, shut)} | (back.get(s, set()) - shut)
            own = {x for x in own - taken if x in tokens}
            if sum(tokens[x] for x in own) >= least or s == order[0]:
                taken |= own
                want |= {(s, x, tokens[x]) for x in own}
    assert {tuple(r) for r in registry.queries()["seed_clusters"](spark, sf).collect()} == want and any(d < 40 for d in taken - seeds)


def test_patterns_links_and_gates(spark):
    pc = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "z")], "id int, cluster string")
    c = lambda *x: spark.createDataFrame([(k,) for k in x], "cluster string")
    assert {r.id: r.state for r in registers.pattern_states(pc, c("a"), c("a", "b", "c", "z")).collect()} == {1: "stale", 2: "orphaned", 3: "unchanged"}
    links = spark.createDataFrame([("p", "A|label"), ("p", "gone"), ("p", "gone"), ("p", "d/A")], "page string, target string")
    pages = spark.createDataFrame([("d/A.md",)], "relpath string")
    assert {r.target for r in registers.broken_links(links, pages).collect()} == {"gone", "d/A"}
    assert {r.target for r in registers.broken_links(links, pages, True).collect()} == {"gone"}
    refs = spark.createDataFrame([("p", "a.ts", "foo"), ("p", "a.ts", "oo"), ("p", "b.ts", "foo")], "page string, path string, symbol string")
    got = registers.symbol_checks(refs, spark.createDataFrame([("a.ts", "let foo = 1")], "path string, content string"))
    assert {(r.path, r.symbol): r.found for r in got.collect()} == {("a.ts", "foo"): True, ("a.ts", "oo"): False, ("b.ts", "foo"): False}
    more = spark.createDataFrame([("p", "f.ts", "$x"), ("p", "f.ts", "a.b"), ("p", "f.ts", "é"), ("p", "f.ts", "b;"), ("p", "f.ts", "a.b;c"), ("p", "f.ts", "c\nd"), ("p", "f.ts", "(")], "page string, path string, symbol string")
    got = registers.symbol_checks(more, spark.createDataFrame([("f.ts", "y$x a.b;c\nd caf\u00e9s (x) \u00e9")], "path string, content string"))
    assert {r.symbol: r.found for r in got.collect()} == {"$x": True, "a.b": True, "é": True, "b;": True, "a.b;c": True, "c\nd": True, "(": False}
    long_ = "[" + ",".join(['"' + "x" * 200 + '"'] * 3) + "]"
    art = spark.createDataFrame([("a.json", "", True), ("b.json", "{", False), ("c.json", '{"x": 1}', False), ("d.json", long_, True), ("state.json", long_, True), ("notes.md", "{", True), ("e.json", None, False)], "name string, text string, critical boolean")
    assert {r.name: (r.problem, r.severity) for r in registers.artifact_gate(art).collect()} == {"a.json": ("empty", "error"), "b.json": ("invalid", "error"), "c.json": (None, None), "d.json": ("ghost", "warning"), "state.json": (None, None), "notes.md": (None, None), "e.json": ("missing", "warning")}
    bars = spark.createDataFrame([("p", "A | b"), ("p", " gone|x")], "page string, target string")
    assert {r.target for r in registers.broken_links(bars, pages).collect()} == {"gone"}


def test_symbols_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(registers, "SYMBOLS_A_TEXT", 3)  # several lists of one file
    words = [f"w{k}" for k in range(4000)]
    text = spark.createDataFrame([("f.ts", " ".join(words) + r" a\Eb"), ("f.ts", "of the second row"), ("g.ts", None)], "path string, content string")
    asked = ["w7", "w39", "w3999", "w4000", "w1 w2", "w1 w3", "1 w2", r"a\Eb", r"\E", "second", ""]
    refs = spark.createDataFrame([("p", f, x) for x in asked for f in ("f.ts", "g.ts")], "page string, path string, symbol string")
    began = time.perf_counter()
    got = {r.symbol for r in registers.symbol_checks(refs, text).collect() if r.found}
    assert got == {"w7", "w39", "w3999", "w1 w2", r"a\Eb", "second"}
    assert time.perf_counter() - began < 30  # windows of every place were as many as the square of the text


def test_rounds_of_circles_send_nothing_to_the_driver(spark):
    edges = spark.createDataFrame([(k, (k + 1) % 5 + 10 * (k // 10)) for x in range(6) for k in range(10 * x, 10 * x + 5)], "src long, dst long")
    for df in (graph.cycles(edges), graph.cycle_paths(edges, graph.cycles(edges))):
        assert df.count() and "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with_join = lambda df: "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert before != "-1" and not with_join(graph.met(edges.withColumnRenamed("dst", "x")).join(edges, "src"))
