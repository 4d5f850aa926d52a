"""Planning, clusters, pages, projects, reports and the stream against hand rows and plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.operators import book, clusters, graph, planner, registers, render, runs, tasks
from weftline.plans import registry
from weftline.sources import ignores, projects, readers, sinks
from weftline.streaming import changes


shown = render.text


def join_in_order(sets):
    """The first pair that overlaps is joined, then all pairs are looked at anew."""
    sets = [(c, set(x), 1) for c, x in sets]
    again = True
    while again:
        again = False
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if len(sets[i][1] & sets[j][1]) / min(len(sets[i][1]), len(sets[j][1])) >= 0.3:
                    sets[i] = (sets[i][0], sets[i][1] | sets[j][1], sets[i][2] + sets[j][2])
                    del sets[j]
                    again = True
                    break
            if again:
                break
    return {(c, f, n) for c, x, n in sets for f in x}


def frame(spark, sets):
    return spark.createDataFrame([(c, f, k) for k, (c, x) in enumerate(sets) for f in x], "cluster string, path string, ord long")


def test_joined_clusters_against_a_plain_loop(spark):
    a, b, c = [f"a{k}" for k in range(7)], [f"b{k}" for k in range(7)], [f"c{k}" for k in range(7)]
    chain = [("x", a + ["s1", "s2", "s3"]), ("y", ["s1", "s2", "s3"] + b[:4] + ["t1", "t2", "t3"]), ("z", ["t1", "t2", "t3"] + c)]
    assert {tuple(r) for r in clusters.merged(frame(spark, chain)).collect()} == join_in_order(chain)
    rng = random.Random(2)
    for n in (12, 40):
        sets = [(f"k{k}", {f"f{rng.randrange(30 + 3 * (k % 7))}" for _ in range(rng.randrange(1, 12))}) for k in range(n)]
        assert {tuple(r) for r in clusters.merged(frame(spark, sets)).collect()} == join_in_order(sets)
    assert clusters.merged(frame(spark, []).limit(0)).count() == 0


def test_joined_clusters_of_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    sets = {}
    for r in rows:
        sets.setdefault(r[0], set()).add(r[1])
    order = sorted(sets)
    want = join_in_order([(c, sets[c]) for c in order])
    cf = spark.createDataFrame([(r[0], r[1], r[0]) for r in rows], "cluster long, path long, ord long")
    assert {tuple(r) for r in clusters.merged(cf).collect()} == want


def test_orphans_join_the_first_of_the_best_clusters(spark):
    held = spark.createDataFrame([("p", "src/a/x.ts", 0), ("q", "src/a/b/y.ts", 1), ("q", "src/z/y.ts", 1), ("r", "lib/y.ts", 2)], "cluster string, path string, ord long")
    left = spark.createDataFrame([("src/a/n.ts", 10, 0), ("src/a/b/c/m.ts", 10, 1), ("src/big/f.ts", 900, 2), ("src/big/g.ts", 900, 2), ("top.ts", 5, 3), ("src/big/sub/h.ts", 1, 4), ("other/k.ts", 1, 5)], "path string, tokens long, ord long")
    got = {r.path: r.cluster for r in clusters.orphans(left, held, 100).collect()}
    assert got == {"src/a/n.ts": "p", "src/a/b/c/m.ts": "p", "src/big/f.ts": "orphan:src/big", "src/big/g.ts": "orphan:src/big", "top.ts": "orphan:.", "src/big/sub/h.ts": "orphan:src/big", "other/k.ts": "orphan:other"}
    homes = clusters.orphan_homes(spark.createDataFrame([("src/a",), ("none",)], "dir string"), held.select("cluster", "ord", paths.dirname(F.col("path")).alias("dir")))
    assert [tuple(r) for r in homes.collect()] == [("src/a", "p", 1)]


def test_names_of_clusters(spark):
    rows = [("1", "pk/balance/_al/a.ts", 0, None, True), ("1", "pk/balance/_al/b.ts", 0, None, False), ("2", "pk/member/_al/a.ts", 1, None, True), ("3", "src/hooks/useX.ts", 2, "UseX", True), ("4", "src/utils/q.ts", 3, None, True), ("5", "pk/balance/_al/c.ts", 4, None, False), ("6", "header/a.ts", 5, None, False)]
    cf = spark.createDataFrame(rows, "cluster string, path string, ord long, component string, is_root boolean")
    got = {r.cluster: (r.name, r.scope, r.id) for r in clusters.named(cf, ["src", "hooks", "utils"]).collect()}
    assert got == {"1": ("_al", "_al", "al"), "2": ("_al", "_al", "al-2"), "3": ("usex", "", "usex"), "4": ("q", "", "q"), "5": ("_al", "_al", "al-3"), "6": ("header", "", "header")}
    names = ["x", "x", "x-2", "x", "y", "x-2", "x-2-2", "y-3", "y", "y"]
    bases = spark.createDataFrame([(str(k), k, b) for k, b in enumerate(names)], "cluster string, ord long, base string")
    used, want = set(), {}
    for k, b in enumerate(names):
        n = next(x for x in (b, *(f"{b}-{j}" for j in range(2, 99))) if x not in used)
        used.add(n)
        want[str(k)] = n
    assert {r.cluster: r.id for r in clusters.unique_ids(bases).collect()} == want
    rows = spark.createDataFrame([("c", f"p{k}", k, 10, k < 2) for k in range(20)] + [("d", "x", 0, 1, False)], "cluster string, path string, pos int, tokens long, is_root boolean")
    part = {r.path: r.part for r in clusters.split_large(rows, 100).collect()}
    assert [part[f"p{k}"] for k in range(20)] == [0, 0, *[1] * 6, *[2] * 6, *[3] * 6] and part["x"] is None
    order = spark.createDataFrame([("a", "medium", 9), ("b", "high", 1), ("c", "medium", 10)], "cluster string, priority string, tokens long")
    assert [r.cluster for r in clusters.in_order(order).collect()] == ["b", "c", "a"]
    some = clusters.majority_directory(spark.createDataFrame([("1", f"a/x/{k}") for k in range(3)] + [("1", "b/y/1"), ("2", "src/f")], "cluster string, path string"), ["src"])
    assert [tuple(r) for r in some.collect()] == [("1", "x", 3)]


def plan(files, bounds):
    """The planner as a loop over folders."""
    subtasks, small = {}, {}
    for folder in sorted({f["folder"] for f in files}):
        own = sorted((f for f in files if f["folder"] == folder), key=lambda f: (f["priority"], -f["n_dep"], f["path"]))
        split = sum(f["tokens"] for f in own) > bounds["split"]
        groups = {r: [f for f in own if f["role"] == r and f["priority"] not in ("P3", "P4")] for r in planner.ROLES}
        first = groups["entry"]
        after = next((r for r in planner.ROLES[1:] if groups[r]), None)
        if first and all(f["is_barrel"] for f in first) and after:
            groups[after], groups["entry"] = groups[after] + first, []
        n = 0
        for role, fs in groups.items():
            total = sum(f["tokens"] for f in fs)
            if not fs:
                continue
            if total < bounds["merge_min"] and split:
                small.setdefault(role, []).append((folder, fs))
                continue
            parts = [[]]
            for f in fs:
                if total > bounds["split"] and parts[-1] and sum(x["tokens"] for x in parts[-1]) + f["tokens"] > bounds["no_split"]:
                    parts.append([])
                parts[-1].append(f)
            for part in parts:
                n += 1
                subtasks[(folder, n)] = [role, [f["path"] for f in part], sum(f["tokens"] for f in part), "P0" if any(f["priority"] == "P0" for f in part) else "P1", None]
    merges = {}
    for role in planner.ROLES:
        got = small.get(role, [])
        tokens = sum(f["tokens"] for _, fs in got for f in fs)
        if len(got) >= 2 and tokens >= bounds["merge_min"]:
            merges[f"cross-{role}"] = (len(got), tokens)
        elif len(got) == 1 and any(k[0] == got[0][0] for k in subtasks):
            last = subtasks[max(k for k in subtasks if k[0] == got[0][0])]
            last[1] = last[1] + [f["path"] for f in got[0][1]]
            last[2] += tokens
            last[4] = f"cross-{role}"
    return subtasks, merges


def test_planner_against_a_plain_loop(spark):
    rng = random.Random(7)
    bounds = {"split": 100, "no_split": 40, "merge_min": 12}
    for n in (15, 60, 200):
        files = [
            {"folder": f"f{rng.randrange(5)}", "path": f"p{k:03}.ts", "priority": rng.choice(["P0", "P1", "P2", "P2", "P3", "P4"]), "tokens": rng.randrange(1, 30), "n_dep": rng.randrange(4), "role": rng.choice(planner.ROLES[:6]), "is_barrel": rng.random() < 0.8}
            for k in range(n)
        ]
        df = spark.createDataFrame(files, "folder string, path string, priority string, tokens long, n_dep long, role string, is_barrel boolean")
        subtasks, merges = plan(files, bounds)
        got = {(r.folder, r.task_no): (r.role, r.tokens, r.n_files, r.priority, r.merge_with) for r in planner.subtasks(df, bounds).collect()}
        assert got == {k: (v[0], v[2], len(v[1]), v[3], v[4]) for k, v in subtasks.items()}
        assert {(r.folder, r.task_no, r.path) for r in planner.members(df, bounds).collect()} == {(*k, p) for k, v in subtasks.items() for p in v[1]}
        assert {r.id: (r.n_folders, r.tokens) for r in planner.cross_merges(df, bounds).collect()} == merges
    some = planner.folders(spark.createDataFrame([("a", "app.ts", "P0", 5, 0, "entry", False), ("b", "x.css", "P4", 5, 0, "utils", False)], df.schema))
    assert {r.folder: (r.priority, r.n_logic, r.n_style, r.n_subtasks) for r in some.collect()} == {"a": ("high", 1, 0, 1), "b": ("medium", 0, 1, 0)}
    assert [r.folder for r in planner.in_order(some).collect()] == ["a", "b"]


def next_fit_loop(rows, most):
    """rows: (key, id, w) in any order; {(key, id): chunk}."""
    out, last, chunk, total = {}, None, 0, None
    for k, n, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if k != last or total is None:
            last, chunk, total = k, 0, None
        if total is not None and total + w > most:
            chunk, total = chunk + 1, None
        total = w if total is None else total + w
        out[k, n] = chunk
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_fit_against_a_loop(spark, parts):
    rng = random.Random(parts)
    rows = [(k, n, rng.choice([0, 1, 2, 3, 9, 25])) for k, m in (("hot", 4000), ("b", 1), ("c", 700), (None, 30), ("d", 300)) for n in range(m)] + [(f"s{n}", 0, 30) for n in range(40)]
    rows += [("zero", n, 0) for n in range(200)] + [("big", n, 50) for n in range(60)]
    df = spark.createDataFrame(rows, "key string, id long, w long").withColumn("more", F.col("id") % 2 == 0).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for x, most in ((df, 20), (df.withColumn("w", F.col("w") / 4), 5.0)):
            got = runs.next_fit_rows(x, ["key"], ["id"], "w", most)
            assert got.columns == ["key", "id", "w", "more", "chunk"]
            assert {(r.key, r.id): r.chunk for r in got.collect()} == next_fit_loop(rows, 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_folds_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(k, n, rng.choice([None, *range(50)])) for k, m in (("hot", 900), (None, 50), ("b", 1), ("c", 200)) for n in range(m)]
    df = spark.createDataFrame(rows, "key string, id long, v long").repartition(3)
    folds = {"low": ("min", F.col("v")), "high": ("max", F.struct("v", "id")), "total": ("sum", F.col("v"))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        for behind in (False, True):
            got = {(r.key, r.id): (r.low, tuple(r.high) if r.high else None, r.total) for r in runs.running(df, ["key"], ["id"], folds, behind).collect()}
            for k, n, _ in rows:
                other = [(v, m) for x, m, v in rows if x == k and (m > n if behind else m < n)]
                known = [v for v, _ in other if v is not None]
                high = max(other, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), default=None)
                assert got[k, n] == (min(known, default=None), high, sum(known) if known else None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_without_one_task_for_a_key(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), ((F.col("id") * 37) % 500).alias("v"))
    got = tasks.ranked(rows, ["key"], ["v"], "place").filter("key = 'hot'").orderBy("v").collect()
    assert [r.place for r in got] == list(range(len(got)))


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8)], "src int, dst int")
    assert {tuple(r) for r in graph.cycles(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert graph.cycles(e.filter("src = 7")).count() == 0
    v = spark.createDataFrame([("no-circular", "a", "b", None, None), ("no-circular", "a", "a", None, None), ("x", "a", "b", None, None), ("no-circular", "a", "b", ["a", "c", "b", "a"], "warn")], "rule string, from string, to string, cycle array<string>, severity string")
    assert sorted(tuple(map(str, r)) for r in graph.violation_cycles(v).collect()) == [("['a', 'b', 'a']", "error"), ("['a', 'c', 'b', 'a']", "warn")]


def test_pages(spark):
    text = "---\ntitle: T\ntags: [hooks]\nsourceFiles: a.ts\n---\n# One\n## `Two`\n#### Three\n| Four | enum | x |\n```js\nexport class Five {}\n```\n[[x]] IS-123-LOW IS-1-LOW"
    raw = spark.createDataFrame([("ch/p.md", text), ("q.md", "no heading")], "relpath string, text string")
    pages = readers.page_source(raw).join(raw, "relpath")
    assert {r.name: (r.type, r.file) for r in book.symbols(pages).collect()} == {"Two": ("hook", "a.ts"), "Three": ("hook", "a.ts"), "Four": ("enum", "a.ts"), "Five": ("hook", "a.ts")}
    assert {r.name: r.type for r in book.headed_symbols(raw).collect()} == {"Two": "component"}
    assert {tuple(r) for r in book.references(raw, spark.createDataFrame([("IS-123-LOW-x.md",)], "name string")).collect()} == {("ch/p.md", "IS-123-LOW", True)}
    known = raw.select(book.known_issues(F.lit("a\n## 已知问题\n\n - IS-1 \n## b\nc"))).first()[0], raw.select(book.known_issues(F.lit("## 已知问题\n暂无"))).first()[0], raw.select(book.known_issues(F.lit("x"))).first()[0]
    assert known == ("- IS-1", None, None)
    assert raw.select(book.issue_title(F.lit("x\n## B\n# A "))).first()[0] == "A" and raw.select(book.issue_title(F.lit("x"))).first()[0] == "Untitled"
    links = book.page_links(pages, spark.createDataFrame([("I1", ["a.ts"]), ("I2", ["z"])], "id string, source_files array<string>"))
    assert [tuple(r) for r in links.collect()] == [(["a.ts"], 0, "ch/p", "- [[ch/p]]")]


def test_patterns(spark):
    raw = spark.createDataFrame([("hook/EXP-a.md", '---\nid: EXP-a\ncategory: hook\nstatus: candidate\ntitle: "A b"\nsource_clusters:\n  - date-picker\n  - x\ntags: [t]\n---\nlong text'), ("hook/EXP-b.md", "---\ncategory: hook\nstatus: candidate\ntitle: a-B!\nsource_clusters: [y]\n---\nt"), ("ui/c.md", "no front")], "relpath string, text string")
    got = projects.pattern_source(raw)
    assert {(r.id, r.category, r.status, tuple(r.clusters)) for r in got.collect()} == {("EXP-a", "hook", "candidate", ("date-picker", "x")), ("EXP-b", "hook", "candidate", ("y",)), ("c", "ui", "active", ())}
    one = registers.promote(got.withColumn("ord", F.when(F.col("id") == "EXP-a", 1).otherwise(2)), spark.createDataFrame([(1,)], "number int")).collect()
    assert [(r.number, r.id, r.title, r.clusters, r.content, r.status, r.slug) for r in one] == [(2, "EXP-002", "a-B!", ["date-picker", "x", "y"], "long text", "active", "a-b")]


def test_projects(spark, tmp_path):
    files = spark.createDataFrame([(1, '{"name": "p", "dependencies": {"svelte": "1"}, "devDependencies": {"vite": "2", "@sveltejs/kit": "3"}}'), (2, "{broken")], "project int, content string")
    maps = projects.package_maps(files)
    got = {r.project: (r.framework, r.build_tool, r.package_manager, r.language) for r in projects.stack(maps, spark.createDataFrame([(1, "yarn.lock"), (1, "a/b.ts")], "project int, path string")).collect()}
    assert got == {1: ("sveltekit", "vite", "yarn", "typescript"), 2: ("node", "unknown", "npm", "javascript")}
    with pytest.warns(UserWarning):
        assert projects.parse_volumes("Wiki, odd") == ["wiki"]
    assert projects.parse_volumes(None) == projects.parse_volumes(" ") == list(projects.VOLUMES)
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/tsconfig.json").write_text("{}")
    assert projects.upward(str(tmp_path / "a/b"), "tsconfig.json") == str(tmp_path / "a") and projects.upward(str(tmp_path), "no such file") is None
    (tmp_path / "a/x.ts").write_text("import a from './y'\nimport 'z'")
    (tmp_path / "a/node_modules").mkdir()
    (tmp_path / "a/node_modules/n.ts").write_text("x")
    assert [r.path for r in readers.scan_tree(spark, str(tmp_path)).collect()] == ["a/x.ts"]
    assert spark.createDataFrame([("a\\b\\c",), ("./x",)], "p string").select(paths.normalized(F.col("p"))).collect() == [("a/b/c",), ("x",)]
    names = spark.createDataFrame([("Hello, World - x",), ("!!",)], "t string").select(paths.slug(F.col("t")), paths.yaml_text(F.concat(F.col("t"), F.lit('"\\\n')))).collect()
    assert [tuple(r) for r in names] == [("hello-world---x", 'Hello, World - x\\"\\\\\\n'), ("pattern", '!!\\"\\\\\\n')]


def test_reports(spark):
    pages = spark.createDataFrame([("ch-a", "one.md", "One", 2), ("ch-a", "two.md", None, 0)], "chapter string, section string, title string, n_files int")
    labels, figures = spark.createDataFrame([("ch-a", "A")], "chapter string, label string"), spark.createDataFrame([(1, 2, 3, 2)], "n_chapters int, n_pages int, n_symbols int, n_files int")
    counted, links = spark.createDataFrame([("ch-a", 2, 2, 1)], "chapter string, n_pages int, n_files int, n_issues int"), spark.createDataFrame([("ch-a", "one.md", "IS-1", "high")], "chapter string, section string, id string, severity string")
    text = shown(render.book(pages, labels, figures, counted, links))
    assert "chapters: 1\npages: 2\nsymbols: 3" in text and "- [One](volume-1-code/ch-a/one.md)" in text and "| [two.md](volume-1-code/ch-a/two.md) | - | 0 | - |" in text and "🔴 [[IS-1]]" in text
    text = shown(render.glossary(spark.createDataFrame([("b", "hook", "x/p.md"), ("a", "odd", "q.md"), ("C", "component", "q.md")], "name string, type string, relpath string")))
    assert text.index("## component") < text.index("## hook") < text.index("## odd") and "| `b` | [[x/p]] |" in text
    i = spark.createDataFrame([("1", "bug", "low", "detected", "2024", "high"), ("2", "bug", "critical", "verified", "2023", None), ("3", "ux", "critical", "fixing", "2024", None)], "id string, type string, severity string, status string, detected_at string, confidence string")
    text = shown(render.issue_dashboard(registers.dashboard(i.withColumn("is_pending", F.lit(True))), registers.pending_list(i)))
    assert "**3**" in text and text.index("[[3]]") < text.index("[[2]]") and "[[1]]" not in text
    index = registers.file_index(i.withColumn("source_files", F.array(F.lit("a.ts")))).withColumn("title", F.lit("t"))
    assert "### `a.ts`" in (text := shown(render.file_issues(index, i.groupBy("severity").agg(F.count("*").alias("n"))))) and "| ⛔ critical | 2 |" in text
    p = spark.createDataFrame([("E1", "hook", "active", "T", "S", ["a", "b", "c", "d"]), ("E2", "hook", "candidate", "T", "", []), ("E3", None, "stale", "T", "", [])], "id string, category string, status string, title string, summary string, clusters array<string>")
    text = shown(render.experience(p, registers.pattern_counts(p), True))
    assert "total_patterns: 2\nactive: 1\nstale: 1\norphaned: 0\ncandidate: 1" in text and "a, b, c..." in text and "E2" not in text and "⚠️" in text
    assert shown(render.experience(p.filter("id = 'E2'"), registers.pattern_counts(p.filter("id = 'E2'")))) == "\n"
    assert "| [[book]] | 3 pages |" in render.master_index({"book": {"pages": 3, "symbols": 0}, "issues": None}) and "issues: not built" in render.master_index({"issues": None})
    rows = tasks.status_counts(spark.createDataFrame([("x" * 50, "completed"), ("x" * 50, "failed"), ("y", "odd")], "folder string, status string"), ["folder"]).withColumns({"n_files": F.lit(3), "tokens": F.lit(12345)})
    text = shown(render.progress(rows))
    assert "12,345" in text and "..." + "x" * 37 in text and "33.3%" in text and text.index("failed (1)") < text.index("pending (1)")
    assert render.percent(1, 3) == "33.3%" and render.percent(0, 0) == "—"
    assert "IS-0011 to IS-0020" in render.prompt({"id": "t", "budget": 15000, "issue_from": 11}, ["a"], feedback="f") and "15,000" in render.prompt({"id": "t", "budget": 15000}, [])
    assert registers.export_rows(spark.createDataFrame([("1", "t", None, "P1", "s", "2024-01-02T", None, "root", ["a", "b"], "", "x-naming.md")], "id string, title string, type string, severity string, status string, detected_at string, chapter string, source string, source_files array<string>, body string, file string")).first().type == "typescript"
    assert [r[0] for r in spark.createDataFrame([("P2 - x",), ("critical",), ("?",)], "p string").select(registers.severity_of(F.col("p"))).collect()] == ["medium", "critical", "unknown"]


def test_file_tasks_prefer_clusters(spark):
    c, s = spark.createDataFrame([("k", "a")], "cluster string, path string"), spark.createDataFrame([("t", "b")], "id string, path string")
    assert tasks.file_tasks(c, s)[1] == "clusters" and [tuple(r) for r in tasks.file_tasks(c.limit(0), s)[0].collect()] == [("b", "t")]
    with pytest.raises(ValueError):
        tasks.file_tasks(None, None)


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"path": "c", "status": "modified"}))
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    run = lambda: changes.invalidations(spark, str(tmp_path / "in"), lambda: e, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert run()
    assert {r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b", "c"}
    (tmp_path / "in/2.json").write_text(json.dumps({"path": "a", "status": "deleted"}))
    assert run()
    got = {(r.batch, r.path, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, "a", "Directly deleted") in got and len(got) == 4


def test_outputs_of_tasks(spark):
    good = "subagent: completed\ngenerated_at: x"
    rows = [("a", "p.md", 900, None), ("b", "p.md", 900, None), ("b", ".gen-done", 9, good), ("c", "p.md", 0, None), ("c", ".gen-done", 9, good), ("d", ".gen-done", 9, good), ("e", "p.md", 9, None), ("e", ".gen-done", 9, good), ("f", "p.md", 900, None), ("f", ".gen-done", 9, "done")]
    out = spark.createDataFrame(rows, "folder string, name string, size long, text string")
    t = spark.createDataFrame([(1, "completed", "a"), (2, "pending", "a/p.md"), (3, "pending", "b"), (4, "completed", "c"), (5, "pending", "d"), (6, "pending", "e"), (7, "pending", "f"), (8, "completed", "x"), (9, "pending", "x"), (10, "pending", None)], "id int, status string, chapter string")
    got = {r.id: (r.passed, r.problem) for r in registers.output_checks(t, out).collect()}
    assert got == {1: (True, None), 2: (False, "no marker"), 3: (True, None), 4: (False, "empty page"), 5: (True, None), 6: (True, "short page"), 7: (False, "marker incomplete"), 8: (False, "missing"), 9: (False, None)}


def test_synced_tasks(spark):
    t = spark.createDataFrame([(1, "pending", ""), (2, "failed", "c"), (3, "in_progress", "c"), (4, "pending", "d")], "id int, status string, chapter string")
    found = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c"), (4, None)], "id int, found string")
    assert {r.id: (r.status, r.chapter) for r in tasks.synced(t, found).collect()} == {1: ("completed", "c"), 2: ("failed", "c"), 3: ("completed", "c"), 4: ("pending", "d")}
    strict = tasks.synced(t, found, spark.createDataFrame([("c",)], "chapter string"))
    assert {r.id: (r.status, r.blocked) for r in strict.collect()} == {1: ("pending", True), 2: ("failed", False), 3: ("in_progress", True), 4: ("pending", False)}


def test_rewritten_texts(spark):
    raw = spark.createDataFrame([(1, "---\nid: a\nstatus: active\n---\nbody status: x"), (2, "---\nid: b\n---\n"), (3, "---\nstatus: active\nstaleReason: old\nstaleAt: old\n---")], "id int, text string")
    c = spark.createDataFrame([(1, "stale", 'a "$1" \\'), (2, "orphaned", "r"), (3, "unchanged", "r")], "id int, action string, reason string")
    got = {r.id: r.text for r in registers.rewritten(raw, c, "now").collect()}
    assert got[1] == '---\nid: a\nstatus: stale\nstaleReason: "a \\"$1\\" \\\\"\nstaleAt: "now"\n---\nbody status: x'
    assert got[2] == '---\nstatus: orphaned\nstaleReason: "r"\nstaleAt: "now"\nid: b\n---\n' and "staleReason: old" in got[3]
    assert {r.text for r in registers.rewritten(raw.filter("id = 3"), c.withColumn("action", F.lit("stale")), "t").collect()} == {'---\nstatus: stale\nstaleReason: "r"\nstaleAt: "t"\n---'}


def test_state_documents(tmp_path):
    assert readers.state_errors({"schemaVersion": 1, "id": 1, "projectPath": "p", "currentPhase": "x", "checkpoint": {"a": 1}, "phaseHistory": [], "config": {"paths": {"projectRoot": 1, "wikiRoot": 1}}}) == ["config.paths.cacheRoot"]
    assert readers.state_errors({"schemaVersion": 2}) == ["schemaVersion", "id", "projectPath", "currentPhase", "checkpoint", "config", "phaseHistory"]
    d = readers.with_path({"a": {"b": 1}, "c": 2}, "a.x.y", 3)
    assert d == {"a": {"b": 1, "x": {"y": 3}}, "c": 2} and readers.at_path(d, "a.x.y") == 3 and readers.at_path(d, "c.z") is None and readers.with_path(d, "c.z", 1)["c"] == {"z": 1}
    path = str(tmp_path / "s.json")
    readers.update_state(path, lambda _: {"n": 1})
    with pytest.raises(KeyError):
        readers.update_state(path, lambda s: {"n": s["missing"]})
    readers.update_state(path, lambda s: {"n": s["n"] + 1})
    assert json.load(open(path)) == {"n": 2} and json.load(open(f"{path}.backup")) == {"n": 1}


def test_sources(spark, tmp_path):
    raw = [("src/a.ts", None, "a", "./a"), ("node_modules/x/i.js", None, "x", "x/i"), (None, "y", None, "y"), (None, None, None, "z"), (None, None, None, "./q"), ("a\\b.ts", "", None, None)]
    got = spark.createDataFrame(raw, "r string, u string, n string, s string").select(readers.dependency_target(F.col("r"), F.col("u"), F.col("n"), F.col("s")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("local", "src/a.ts"), ("external", "x"), ("external", "y"), ("external", "z"), ("local", "q"), ("local", "a/b.ts")]
    for name in ("src/a.ts", "src/gen/b.ts", "logs/c.js", "deep/logs/d.js", "src/e.test.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("# c\n\n/src/gen\nlogs/\n*.test.ts\n")
    assert {r.path for r in readers.scan_tree(spark, str(tmp_path)).collect()} == {"src/a.ts"}
    with pytest.raises(Exception, match="(?i)path"):
        readers.scan_tree(spark, str(tmp_path / "nowhere"))
    readers.write_export(spark.createDataFrame([("a,b", None)], "x string, y string"), str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes() == b'\xef\xbb\xbfx,y\n"a,b",\n'
    words = spark.createDataFrame([("b",), ("A",), ("é",), ("a",), ("f",)], "w string")
    assert [r.w for r in book.in_locale_order(words, "w").collect()] == ["a", "A", "b", "é", "f"]
    assert [tuple(r) for r in book.remaining(spark.createDataFrame([("c", "a"), ("c", "b")], "cluster string, path string"), spark.createDataFrame([("c", "a")], "cluster string, path string")).collect()] == [("c", "b")]
    order = registers.latest_first(spark.createDataFrame([(1, "low", "2"), (2, "critical", "1"), (3, "critical", "2")], "id int, severity string, detected_at string"))
    assert [r.id for r in order.collect()] == [3, 2, 1]


def test_source_files_and_frontmatter_variants(spark):
    names = ["src/a.ts", "assets/b.ts", "assets/c.md", "src/d.md", "node_modules/e.ts", "x/dist/f.ts", "g.txt", "img/h.md"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path for r in readers.source_files(files, ("md",)).collect()} == {"src/a.ts", "assets/b.ts", "src/d.md"}
    assert {r.path for r in readers.source_files(files).collect()} == {"src/a.ts", "assets/b.ts"}
    raw = spark.createDataFrame([("---\nissueId: 'x'\nsource_files:\n  - a\n  - b\n---",)], "t string")
    one = lambda **how: raw.select(readers.frontmatter(F.col("t"), **how)).first()[0]
    assert one() == {"id": "x", "source_files": "a\nb"}
    assert one(aliases=False) == {"issueId": "x", "source_files": "a\nb"}
    assert one(strip_quotes=False)["id"] == "'x'" and one(block_lists=False)["source_files"] == ""


def test_marked_issues_keep_a_history(spark):
    i = spark.createDataFrame([(1, "detected", None), (2, "fixed", None), (3, "stale", None)], "id int, status string, history array<struct<at:string,from:string,to:string>>")
    c = spark.createDataFrame([(1, "stale"), (3, "stale")], "id int, new_status string")
    got = {r.id: (r.status, [tuple(h) for h in r.history]) for r in registers.marked(i, c, "now").collect()}
    assert got == {1: ("stale", [("now", "detected", "stale")]), 2: ("fixed", []), 3: ("stale", [])}


#: What git ignores of some paths, by rules of several folders: folder, rules, then paths below with git's answer.
IGNORE_RULES = [
    ("", "# note\n\n*.log\n!keep.log\n/root.txt\nbuild/\ndocs/*.md\n**/cache\nlib/**/gen\nall/**\n\\!odd\n\\#hash\nsp ace\ntrail   \nq?.ts\n[ab].c\n[!x]z.h\nfoo*bar\n"),
    ("src", "!*.log\n/only.ts\ngen/\n!build/\n"),
    ("src/deep", "*.log\n*\n!stay.ts\n"),
]
IGNORE_PATHS = {
    "a.log": True, "keep.log": False, "x/keep.log": False, "x/y/a.log": True, "root.txt": True, "x/root.txt": False, "build/a.ts": True, "x/build/a.ts": True, "y/build": False, "docs/a.md": True, "docs/x/a.md": False, "x/docs/a.md": False,
    "cache/a": True, "x/cache/a": True, "lib/gen/a": True, "lib/x/y/gen/a": True, "all/a": True, "!odd": True, "#hash": True, "sp ace/a": True, "trail": True, "q1.ts": True, "q12.ts": False, "q/.ts": False, "a.c": True, "c.c": False, "yz.h": True, "xz.h": False, "foo1bar": True, "foo/bar": False,
    "src/a.log": False, "src/only.ts": True, "src/x/only.ts": False, "src/gen/a": True, "src/build/a.ts": False, "src/deep/a.log": True, "src/deep/stay.ts": False, "src/deep/x/stay.ts": True, "lib/gen2/a": False,
}


def test_ignore_rules_of_folders(spark):
    files = spark.createDataFrame([(p,) for p in IGNORE_PATHS], "path string")
    texts = spark.createDataFrame(IGNORE_RULES, "folder string, text string")
    left = {r.path for r in ignores.kept(files, ignores.rules(texts)).collect()}
    assert {p: p not in left for p in IGNORE_PATHS} == IGNORE_PATHS
    assert ignores.kept(files, ignores.rules(texts.limit(0))).count() == len(IGNORE_PATHS)


def test_ignore_files_are_found_below_the_root(spark, tmp_path):
    for name, text in (("a/x.ts", "1"), ("a/y.ts", "1"), ("b/y.ts", "1"), ("a/.gitignore", "y.ts"), (".gitignore", "b/*\n!b/y.ts")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(r.path for r in readers.scan_tree(spark, str(tmp_path)).collect()) == ["a/x.ts", "b/y.ts"]


def test_analysis_and_violations(spark):
    text = json.dumps({"modules": [{"source": "/w/src/a.ts", "dependencies": [{"resolved": "/w/src/b.ts", "circular": True}, {"module": "./c", "resolved": ""}, {"resolved": "/w/node_modules/x/i.js", "moduleName": "x"}, {"module": "y"}]}, {"source": "/w/src/b.ts", "dependencies": []}, {"source": "/w/node_modules/x/i.js", "dependencies": []}], "summary": {"violations": [{"rule": {"name": "no-circular", "severity": "warn"}, "from": "a.ts", "to": "b.ts"}, {"rule": {"name": "other"}, "from": "a", "to": "b"}]}})
    modules, edges, bad = readers.analysis(spark.createDataFrame([(text,)], "text string"), "/w/src")
    assert {r.source for r in modules.collect()} == {"a.ts", "b.ts"}
    assert {(r.src, r.dst, r.type, r.circular) for r in edges.collect()} == {("a.ts", "b.ts", "local", True), ("a.ts", "c", "local", False), ("a.ts", "x", "external", False), ("a.ts", "y", "external", False)}
    assert [tuple(r) for r in graph.violation_cycles(bad).collect()] == [(["a.ts", "b.ts", "a.ts"], "warn")]


def test_file_rows_are_written_all_or_none(spark, tmp_path):
    folder = str(tmp_path / "out")
    names = lambda: {str(p.relative_to(folder)): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    one = spark.createDataFrame([(f"a/p{k}.md", f"old {k}") for k in range(20)] + [("top.md", None)], "path string, text string").repartition(4)
    sinks.write_files(one, folder)
    old = {**{f"a/p{k}.md": f"old {k}" for k in range(20)}, "top.md": ""}
    assert names() == old
    for bad in ("../x.md", "/etc/x", "_staged-1/x"):
        with pytest.raises(Exception, match="(?i)below the folder"):
            sinks.write_files(spark.createDataFrame([("a/p1.md", "new"), (bad, "x")], "path string, text string").repartition(2), folder)
        assert names() == old  # the old files are whole
    with pytest.raises(Exception, match="path of another row"):
        sinks.write_files(spark.createDataFrame([("a/p1.md", "x"), ("a/p1.md", "y")], "path string, text string"), folder)
    assert names() == old
    sinks.write_files(spark.createDataFrame([("a/p1.md", "new"), ("b/c/q.md", "é")], "path string, text string"), folder)
    assert names() == {**old, "a/p1.md": "new", "b/c/q.md": "é"}
    # a job that died after its manifest, with one file renamed
    (tmp_path / "out/_staged-j/t").mkdir(parents=True)
    (tmp_path / "out/_staged-j/t/1").write_text("two")
    (tmp_path / "out/_manifest-j.json").write_text(json.dumps({"staged": "_staged-j", "files": [["_staged-j/t/0", "a/p1.md"], ["_staged-j/t/1", "a/p2.md"]]}))
    assert sinks.recover(folder) == 2 and names() == {**old, "a/p1.md": "new", "a/p2.md": "two", "b/c/q.md": "é"}


def test_prompts_and_reports_reach_the_disk(spark, tmp_path):
    schedule = spark.createDataFrame([("t1", "run", 15000, 1, "ch-a/"), ("t2", "skip", 1, None, "x")], "id string, action string, budget long, issue_from long, chapter string")
    text = render.prompts(schedule, spark.createDataFrame([("t1", "a.ts")], "id string, path string"))
    sinks.write_files(text.select(F.concat("id", F.lit(".md")).alias("path"), "text"), str(tmp_path / "prompts"))
    assert [p.name for p in (tmp_path / "prompts").iterdir()] == ["t1.md"] and "- `a.ts`" in (tmp_path / "prompts/t1.md").read_text()
    lines = render.glossary(spark.createDataFrame([(f"n{k:04}", "hook", "x/p.md") for k in range(500)], "name string, type string, relpath string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        render.write(lines, str(tmp_path / "glossary"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "glossary").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == render.text(lines) and len(parts) > 1


def test_whole_answers_of_pages_and_issues(spark):
    sf = "/root/testdata/sf0.001"
    q = registry.queries()
    counts = {r.relpath: r.n_issues for r in q["page_issue_counts"](spark, sf).collect()}
    pairs = q["page_issues"](spark, sf).collect()
    assert len(pairs) == len(set(pairs)) == sum(counts.values())
    issues, links = spark.read.parquet(f"{sf}/events.parquet").count(), q["issue_page_links"](spark, sf).collect()
    assert len(links) == len(pairs) and len({r.id for r in links}) == issues
    docs = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    got = {(r.relpath, r.field) for r in q["missing_fields"](spark, sf).collect()}
    assert got == {(f"p{k}", f) for k in docs for f, m in (("tags", 3), ("updated", 4), ("source", 5)) if k % m == 0}


def _pages_and_issues(spark):
    """Pages and issues of two sets of files, with empty names, repeated rows and an issue without an id."""
    pages = [(f"ch-{k % 3}/p{k}.md", ["a", "", "a"] if k % 5 else ["b", None]) for k in range(400)] + [("ch-0/none.md", []), ("ch-0/null.md", None), ("ch-0/p3.md", ["b"])]
    issues = [(k, ["a", "x"] if k % 3 else ["b"]) for k in range(4000)] + [(None, ["a"]), (7, ["", "x"]), (8, None)]
    own, theirs = {}, {}
    for rows, out in ((pages, own), (issues, theirs)):
        for k, files in rows:
            out.setdefault(k, set()).update(f for f in files or [] if f)
    want = {(p, i) for p, a in own.items() for i, b in theirs.items() if a & b}
    return spark.createDataFrame(pages, "relpath string, source_files array<string>"), spark.createDataFrame(issues, "id long, source_files array<string>"), want


def test_lines_of_issues_are_told_in_blocks(spark):
    pages, issues, want = _pages_and_issues(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = book.issue_links(pages, issues).rdd.glom().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rows = [r for p in parts for r in p]
    assert len(rows) == len(want) and {(r.link + ".md", r.id) for r in rows} == want
    places = {}
    for r in rows:
        places.setdefault(r.id, []).append((r.link, r.place, r.line))
    assert all(sorted(x) == [(k, n, f"- [[{k}]]") for n, k in enumerate(sorted(k for k, _, _ in x))] for x in places.values())
    changes = sum(a.link != b.link for p in parts for a, b in zip(p, p[1:]))  # a line changes once a block, not at each row
    assert changes < len(rows) / 50


def test_pages_meet_issues_in_blocks(spark):
    pages, issues, want = _pages_and_issues(spark)
    parts = book.page_issue_pairs(pages, issues).rdd.glom().collect()
    rows = [r for p in parts for r in p]
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    long = max(parts, key=len)  # the ids of a block come again for the next page
    assert len(long) > 20 * book.BLOCK
    assert all(len({r.id for r in long[k : k + 5 * book.BLOCK]}) <= 2.5 * book.BLOCK for k in range(0, len(long), 5 * book.BLOCK))


def test_ranges_hold_some_rows_each(spark, monkeypatch):
    monkeypatch.setattr(runs, "RANGE_ROWS", 100)
    rows = spark.range(3000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("w"))
    assert runs.ranged(rows, ["k"], ["id"]).rdd.getNumPartitions() >= 25
    want, chunk, total = {}, 0, 0
    for k in range(3000):
        chunk, total = (chunk + 1, k % 7) if total + k % 7 > 20 else (chunk, total + k % 7)
        want[k] = chunk
    assert {r.id: r.chunk for r in runs.next_fit_rows(rows, ["k"], ["id"], "w", 20).collect()} == want


def test_tasks_without_output_are_not_dealt_by_their_chapter(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = spark.range(4000).select("id", F.lit("pending").alias("status"), F.lit("").alias("chapter"))
        found = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("found"))
        got = tasks.synced(t, found, spark.createDataFrame([("c1",), ("c1",)], "chapter string"))
        assert max(got.rdd.glom().map(len).collect()) < 2000
        assert {(r.id, r.status, r.chapter, r.blocked) for r in got.collect()} == {(k, "pending", "", k % 100 == 0) if k % 100 or k % 3 == 1 else (k, "completed", f"c{k % 3}", False) for k in range(4000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_overlaps_of_large_and_small_clusters(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PAIRS", 500)  # several runs of clusters in a part
    rng = random.Random(4)
    sets = {f"k{k}": set(rng.sample(range(900), rng.choice((1, 3, 8, 120, 300, 420)))) for k in range(40)}
    sets["k5"] = set(sorted(sets["k9"])[: len(sets["k9"]) // 2]) | {5000 + x for x in range(100)}
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.3 and sets[a] & sets[b]}
    rows = spark.createDataFrame([(c, f) for c, x in sets.items() for f in x] * 2 + [("k1", None)], "cluster string, path long")
    sizes = {c: len(x) + (c == "k1") for c, x in sets.items()}
    want = {w for w in want if w[2] / min(sizes[w[0]], sizes[w[1]]) >= 0.3}
    got = clusters.overlaps(rows)
    assert {(r.a, r.b, r.shared) for r in got.collect()} == want and want
    some = spark.createDataFrame([(f"s{k}", x) for k in range(60) for x in range(1000 * (k % 30), 1000 * (k % 30) + 200)], "cluster string, path int")
    held = some.withColumnRenamed("cluster", "c")
    assert clusters.overlapping(held, held.groupBy("c").agg(F.count("*").alias("size"))).count() == 30


def test_homes_of_directories_are_counted_once(spark):
    rows = [(c, d, c) for c in range(3) for d in ("a", "a/b", "a/b/c", "x")] + [(2, "a/z", 2)]
    held = spark.createDataFrame(rows * 2, "cluster int, dir string, ord int")
    got = clusters.orphan_homes(spark.createDataFrame([("a",), ("a/b",), ("a/b/q",), ("y",), ("a",)], "dir string"), held)
    assert {tuple(r) for r in got.collect()} == {("a", 2, 4), ("a/b", 0, 3), ("a/b/q", 0, 2)}
    assert graph.spread(spark.range(1000), "id", rows=10).rdd.getNumPartitions() == 100
