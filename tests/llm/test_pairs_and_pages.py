"""Jaccard join, cover trees, HTML extraction and the pipeline against plain versions."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, covertree, html, jaccard


def reach(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (7, 7)]
    nodes = sorted({x for e in links for x in e} | {5000})
    got = common.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == reach(nodes, links)
    assert common.components(None, spark.createDataFrame([], "a long, b long")).count() == 0


def family(rng, n, base, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies around the bound, a passage that all share, short and odd texts, one large group."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \t\n", "One", "one", "a b c d", "a b c d", "a b c d e", "A B C D E", "a b c d e f"]
    for edits in (0, 1, 2, 3, 4, 5):
        texts += family(rng, 5, [word() for _ in range(120)], edits)
    texts += [" ".join([word() for _ in range(rng.randrange(30, 200))] + passage) for _ in range(80)]
    texts += family(rng, 60, [word() for _ in range(100)], 2)
    texts += [texts[-1]] * 10
    rows = list(enumerate(texts)) + [(3, "One")]
    rng.shuffle(rows)
    return rows


def test_jaccard_against_all_pairs(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # many blocks
    sets = {}
    for d, t in corpus:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(corpus, "doc_id long, text string").withColumns({"n": F.lit("clash"), "rep": F.lit(0)})
    got = jaccard.resolve(df).collect()
    want = reach(sets, links)
    assert len(got) == len(corpus) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}
    left = jaccard.keep_one(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))
    assert jaccard.resolve(df.limit(0)).count() == 0


def test_shingle_sets_of_odd_texts():
    import pyarrow as pa
    import xxhash

    def plain(text):
        w = [xxhash.xxh3_64_intdigest(x) for x in (text or "").encode().lower().split()]
        runs = [w[k : k + 5] for k in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
        out = set()
        for run in runs:
            h = len(run)
            for x in run:
                h = (h * 0x9E3779B97F4A7C15 + x) % 2**64
            out.add(h)
        return sorted(common.mixed(np.array(sorted(out), np.uint64)).tolist())

    texts = [None, "", " \n", "a", "a b c d", " A  b\x0bc\td e\x0cf\r", "\x1c\x1d a\x85b c \xc0B \xc9", "a b c d e f a b c d e f", "\x00 x", "x\x1fy z \u2003 v \xa0 w u", "a b c d e"]
    assert [s.tolist() for s in jaccard.shingle_sets(pa.array(texts))] == [plain(t) for t in texts]
    assert jaccard.shingle_sets(pa.array([], pa.string())) == [] and [s.tolist() for s in jaccard.shingle_sets(pa.array(["", None]))] == [[], []]


def test_checkpoints_give_their_shuffle_files_back(spark):
    """What an operator shuffled for a step must not stay on disk until the driver collects its garbage."""
    def shuffled():
        return {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}

    before = shuffled()
    df = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).count()
    kept = [common.durable(df) for _ in range(2)]
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and [k.count() for k in kept] == [1000, 1000] and df.count() == 1000
    assert spark.conf.get(common.FREED) == "false"


def test_bags_much_alike_are_joined(spark):
    """Of 300 bags of the same 40 documents but one or two, each document goes a few times, not 300 times."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**62, 60, np.uint64) for _ in range(40)]
    sets[7] = np.concatenate([sets[3][:57], sets[7][:2]])
    rows = [(t, d) for t in range(300) for d in range(40) if d not in {8 + t % 32, 8 + t // 32}]
    bags = spark.createDataFrame(rows, "t long, doc_id long")
    table = spark.createDataFrame([(d, len(s), bytearray(np.sort(s).tobytes())) for d, s in enumerate(sets)], "doc_id long, n long, shingles binary")
    assert {tuple(sorted(r)) for r in jaccard.settle(bags, spark.createDataFrame([], "a long, b long"), table).collect()} == {(3, 7)}
    rows = spark.createDataFrame([(t, d, d, 38) for t, d in rows], "t long, doc_id long, c long, m long")
    joined = jaccard.joined_bags(rows)
    assert 40 <= joined.count() <= 400 and joined.select("doc_id").distinct().count() == 40
    # every pair of a bag is in a joined one
    pairs = lambda x: {(r.a, r.b) for r in x.alias("x").join(x.alias("y"), "t").selectExpr("x.doc_id a", "y.doc_id b").distinct().collect()}
    assert pairs(rows) == pairs(joined)


def test_prefix_length_is_the_bound():
    for n in range(1, 200):
        least = next(k for k in range(n + 1) if 100 * k >= 80 * n)
        assert jaccard.prefix_length(n) == n - least + 1


def vectors(rng):
    centres = rng.standard_normal((40, 16))
    rows = []
    for k in range(600):
        v = centres[rng.integers(40)] + rng.standard_normal(16) * 0.12 if k % 3 else rng.standard_normal(16)
        rows.append((k, v.astype("float32").tolist(), int(rng.integers(3))))
    rows += [(700 + k, rows[5][1], rows[5][2]) for k in range(5)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] * 16, 1), (803, [1.0, None], 1), (804, [], 1), (805, rows[5][1], None), (806, [1.0, 0.0], 1), (807, [2.0, 0.0], 1)]
    return rows


@pytest.mark.parametrize("block, pivots", [(32, 3), (32, 16), (4, 16), (2048, 16)])
def test_cover_tree_against_all_pairs(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(covertree, "BLOCK", block)  # several levels of cells, visitors and blocks
    monkeypatch.setattr(covertree, "PIVOTS", pivots)
    rows = vectors(np.random.default_rng(4))
    fine = {k: np.array(v, float) for k, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {k: y for k, _, y in rows}
    links = []
    for a, b in itertools.combinations(fine, 2):
        x, y = fine[a], fine[b]
        if label[a] == label[b] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
            links.append((a, b))
    assert len(links) > 300
    want = reach([r[0] for r in rows], links)
    n = {k: sum(k in e for e in links) for k in want}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "d": F.lit("x")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect()}
    assert got == {k: (n[k], want[k], want[k] == k) for k in want}
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_levels():
    x = np.random.default_rng(0).standard_normal((200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = covertree.CoverTree(x)
    for (centres, cover), r in zip(t.levels, covertree.RADII):
        assert (cover <= r + 1e-9).all() and len(set(centres)) == len(centres)
    assert sorted(np.concatenate(t.leaves)) == list(range(200))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;line<br>second  line<p>Third <i>with</i> <a href="x">link</a>.<aside>See also</aside><form><input>Send</form>
<section class="comments"><p>Reader says</p></section></article><div id="sidebar">Side</div><footer>&copy; x</footer>"""


def test_blocks_of_a_page():
    assert " ".join(x for x, m in html.blocks(PAGE) if m) == "Title & more First line second line Third with link."
    assert html.blocks(None) == [] and html.blocks("") == [] and html.blocks("plain < text &lt; x") == [("plain < text < x", False)]
    assert html.blocks("<p>a<p>b</div></p>c") == [("a", False), ("b", False), ("c", False)]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        got = [a[k] for k in sorted(html.common_lines(a, b))]
        it = iter(b)
        assert len(got) == lcs(a, b) and all(any(x == y for y in it) for x in got)


def test_extraction(spark):
    plain = lambda k: f"<div>Welcome</div><div>Top stories</div><p>Own text {k}</p><p>More of {k}</p><div>Imprint</div>"
    rows = [(k, f"http://h.example/en/{100 + k}", plain(k)) for k in range(6)] + [(10, "http://h.example/en/200", PAGE), (11, None, plain(11)), (12, "http://x.example/1", None), (13, "not a url", "<p>x")]
    rows += [(10, "http://h.example/en/200", PAGE), (20, "http://c.example/a", "<p>same"), (21, "http://c.example/b", "<p>same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "lines": F.lit(2)})
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert html.extract(df).count() == len(rows)
    assert all(got[k][0] == f"Own text {k} More of {k}" for k in range(6))
    assert got[10][0] == "Title & more First line second line Third with link." and got[11][0] == "Welcome Top stories Own text 11 More of 11 Imprint"
    assert got[12] == ("", 0) and got[13] == ("x", 1) and got[20][0] == got[21][0] == "same"
    assert html.extract(df.limit(0)).count() == 0


def test_pages_of_a_large_host_are_differenced_whatever_their_paths(spark):
    """300 pages whose paths share 47 characters, and one beside another host's: furniture goes, text stays."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    front = "/company/newsroom/press-releases/archive/2023/q"
    rows, want = [], {}
    for k in range(300):
        own = [" ".join(word() for _ in range(8)) for _ in range(rng.randrange(2, 6))]
        want[k] = " ".join(own)
        rows.append((k, f"https://big.example{front}{k:03}", f"<div>Home Products</div><p>{'</p><p>'.join(own)}</p><div>All rights reserved</div><p>Subscribe to updates</p>"))
    rows.append((900, "https://zz.example/a", "<p>Alone</p><div>All rights reserved</div>"))
    want[900] = "Alone All rights reserved"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 7):
        assert {r.page_id: r.text for r in html.extract(df.repartition(n)).collect()} == want


def test_neighbours_over_ranges_against_a_plain_loop(spark):
    rng = random.Random(11)
    rows = [(f"h{k % 3}", f"/p{rng.randrange(500):03}", k.to_bytes(4, "big"), rng.random() < 0.8, [rng.randrange(40) for _ in range(rng.randrange(9))]) for k in range(200)]
    order = sorted(rows, key=lambda r: r[:3])
    want = {}
    for k, r in enumerate(order):
        near = [order[j][4] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == r[0]]
        if r[3] and (drop := html.furniture(r[4], near)):
            want[r[0], r[2]] = drop
    df = spark.createDataFrame(rows, "host string, path string, key binary, open boolean, hashes array<long>")
    assert {(r.host, bytes(r.key)): r.drop for r in html.neighboured(df).collect()} == want and len(want) > 50


def test_differencing_on_pages_without_mark_up(spark):
    """The articles of the table's pages put into sites whose furniture has no telling tag or name."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    rng = random.Random(12)
    menu = {s: [" ".join(f"m{rng.randrange(900)}" for _ in range(3)) for _ in range(6)] for s in range(4)}
    rows, want = [], {}
    for k, r in enumerate(pages):
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        s = k % 4
        div = lambda xs: "".join(f"<div>{x}</div>" for x in xs)
        rows.append((k, f"https://s{s}.example/{'news' if k % 3 else 'blog'}/{k}", f"<body>{div(menu[s][:3])}<div>{inside}</div>{div(menu[s][3:])}</body>"))
        want[k] = [x for x, _ in html.blocks(f"<div>{inside}</div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    exact = sum(got[k] == " ".join(want[k]) for k in want)
    assert not any(m in got[k] for k in got for m in menu[k % 4]) and exact >= 0.95 * len(want)


def test_pages_against_their_articles(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub("</?b>", "", x))).strip() for x in re.split("</?(?:h1|p|br)>", inside)]
        want[r.page_id] = " ".join(x for x in parts if x)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_names_and_figures_inside_an_article():
    """Classes of several words, formulas and drawings belong to the article; furniture in it does not."""
    page = """<body><svg><text>Logo</text></svg><div class="share-price">Out</div><article><p>One <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two</p><div class="share-price">Price 12</div><p class="notice-board">Board</p>
    <svg><title>t</title><text>Drawn</text></svg><div class="social-share">S</div><div id="related_posts">R</div><ul class="x share">U</ul><div class="ad-slot-3">A</div><select><option>O</option></select><p class="headers">Last</p></article></body>"""
    assert [t for t, own in html.blocks(page) if own] == ["One x=2 two", "Price 12", "Board", "Drawn", "Last"]


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, seen, sf).cache()
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in seen.select("doc_id").collect()}
        assert k != 2 or len(ids) == seen.count()
        seen = out
    got = pipeline.run(spark, sf)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in seen.collect()} and len(pipeline.STAGES) == 5


def test_pipeline_odd_rows(spark, tmp_path):
    """Null, empty, repeated and long texts, columns named like the operators', and empty tables."""
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.limit(5).withColumns({"doc_id": F.col("doc_id") + 90_000, "text": F.when(F.col("doc_id") % 2 == 0, None).otherwise("")})
    long_ = docs.limit(1).withColumns({"doc_id": F.lit(99_000).cast("long"), "text": F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda k: F.concat(F.lit("word"), k.cast("string"))))})
    rows = docs.unionAll(docs.limit(3)).unionAll(odd).unionAll(long_).withColumns({"_taken": F.lit(1), "_n": F.lit("x"), "c0": F.lit(2), "piece": F.lit(3), "lang": F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("lang"))})
    for name, d in (("some", rows), ("none", rows.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = pipeline.run(spark, f"{tmp_path}/some").collect()
    ids = [r.doc_id for r in got if r.piece == 0]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in rows.select("doc_id").collect()} and not any(90_000 <= d < 90_100 for d in ids)
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
