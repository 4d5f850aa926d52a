"""Queries of planning, pages, exports and projects, and the same in DuckDB SQL.

The SQL of pages is written from how their texts are made (``views.md``), not from the patterns that read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import code, paths
from weftline.operators import book, clusters, graph, planner, registers, render, tasks
from weftline.plans.base import query
from weftline.sources import ignores, projects, readers, views

# ---- planning ---------------------------------------------------------------------------------

ROLE = "CASE role WHEN 'entry' THEN 0 WHEN 'ui-components' THEN 1 WHEN 'business-components' THEN 2 WHEN 'hooks' THEN 3 WHEN 'utils' THEN 4 WHEN 'types' THEN 5 ELSE 6 END"
NAME = "['entry','ui-components','business-components','hooks','utils','types','other']"
#: Groups of roles behind the inlining of barrels, and which of them are small.
GROUPED = f"""t AS (SELECT CAST(least(300000, greatest(20000, round(sum(tokens) * 0.05::DOUBLE))) AS BIGINT) AS split, CAST(least(150000, greatest(10000, round(sum(tokens) * 0.025::DOUBLE))) AS BIGINT) AS no_split, CAST(least(15000, greatest(3000, round(sum(tokens) * 0.003::DOUBLE))) AS BIGINT) AS merge_min FROM plan_files),
    whole AS (SELECT folder, sum(tokens) AS folder_tokens FROM plan_files GROUP BY 1), l AS (SELECT *, {ROLE} AS ro FROM plan_files WHERE priority NOT IN ('P3', 'P4')),
    n AS (SELECT folder, min(ro) FILTER (ro > 0) AS nxt, bool_and(is_barrel) FILTER (ro = 0) AS idle FROM l GROUP BY 1),
    g AS (SELECT l.folder, path, priority, tokens, n_dep, CASE WHEN ro = 0 AND idle AND nxt IS NOT NULL THEN nxt ELSE ro END AS ro, CASE WHEN ro = 0 AND idle AND nxt IS NOT NULL THEN 1 ELSE 0 END AS moved FROM l JOIN n USING (folder)),
    r AS (SELECT folder, ro, sum(tokens) AS role_tokens FROM g GROUP BY 1, 2), gs AS (SELECT g.*, role_tokens, role_tokens < merge_min AND folder_tokens > split AS small, role_tokens > split AS large, no_split FROM g JOIN r USING (folder, ro) JOIN whole USING (folder), t),
    o AS (SELECT *, row_number() OVER (PARTITION BY folder, ro ORDER BY moved, priority, n_dep DESC, path) AS k FROM gs WHERE NOT small),
    cut(folder, ro, k, chunk, total) AS (SELECT folder, ro, k, 0, tokens::DOUBLE FROM o WHERE k = 1 UNION ALL SELECT o.folder, o.ro, o.k, CASE WHEN o.large AND total + o.tokens > o.no_split THEN chunk + 1 ELSE chunk END, CASE WHEN o.large AND total + o.tokens > o.no_split THEN o.tokens::DOUBLE ELSE total + o.tokens END FROM cut JOIN o ON o.folder = cut.folder AND o.ro = cut.ro AND o.k = cut.k + 1),
    m AS (SELECT o.*, chunk FROM o JOIN cut USING (folder, ro, k)), c AS (SELECT ro, sum(tokens) AS tokens, count(DISTINCT folder) AS n_folders, count(*) AS n_files FROM gs WHERE small GROUP BY 1),
    s AS (SELECT folder, ro, chunk, row_number() OVER (PARTITION BY folder ORDER BY ro, chunk) AS task_no, sum(tokens) AS tokens, count(*) AS n_files, bool_or(priority = 'P0') AS top, bool_or(large) AS large FROM m GROUP BY 1, 2, 3),
    back AS (SELECT folder, sum(tokens) AS tokens, count(*) AS n_files, max(ro) AS ro FROM gs JOIN (SELECT ro FROM c WHERE n_folders = 1) USING (ro) WHERE small GROUP BY 1),
    last AS (SELECT folder, max(task_no) AS task_no FROM s GROUP BY 1)"""
ID = "replace(folder, '/', '_')"
SUBTASKS = f"""SELECT s.folder, {NAME}[s.ro + 1] AS role, s.task_no, replace(s.folder, '/', '_') || '-' || {NAME}[s.ro + 1] || (CASE WHEN large AND s.task_no > 1 THEN '-' || s.task_no ELSE '' END) AS id,
    'ch-' || replace(s.folder, '/', '_') || '/sec-' || {NAME}[s.ro + 1] || (CASE WHEN s.task_no > 1 THEN '-' || s.task_no ELSE '' END) || '.md' AS chapter, CAST(s.tokens + coalesce(b.tokens, 0) AS BIGINT) AS tokens, s.n_files + coalesce(b.n_files, 0) AS n_files, CASE WHEN top THEN 'P0' ELSE 'P1' END AS priority,
    CASE WHEN b.folder IS NOT NULL THEN 'cross-' || {NAME}[b.ro + 1] END AS merge_with FROM s LEFT JOIN last ON last.folder = s.folder AND last.task_no = s.task_no LEFT JOIN back b ON b.folder = last.folder"""


@query(f"WITH RECURSIVE {GROUPED} {SUBTASKS}", "plan_files")
def folder_subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.subtasks(views.plan_files(spark, sf_dir))


@query(f"WITH RECURSIVE {GROUPED} SELECT 'cross-' || {NAME}[ro + 1] AS id, {NAME}[ro + 1] AS role, n_folders, n_files, CAST(tokens AS BIGINT) AS tokens, 'appendix/cross-' || {NAME}[ro + 1] || '.md' AS chapter FROM c, t WHERE n_folders >= 2 AND tokens >= merge_min", "plan_files")
def cross_folder_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.cross_merges(views.plan_files(spark, sf_dir))


@query(f"WITH RECURSIVE {GROUPED} SELECT folder, path, {NAME}[ro + 1] AS role FROM gs JOIN c USING (ro), t WHERE small AND n_folders >= 2 AND c.tokens < merge_min", "plan_files")
def planner_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.dropped(views.plan_files(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {GROUPED} SELECT folder, count(*) AS n_files, count(*) FILTER (priority NOT IN ('P3','P4')) AS n_logic, count(*) FILTER (priority = 'P4') AS n_style, CAST(sum(tokens) AS BIGINT) AS tokens, 'medium' AS priority, sum(tokens) > (SELECT split FROM t) AS should_split,
    coalesce((SELECT count(*) FROM s WHERE s.folder = p.folder), 0) AS n_subtasks FROM plan_files p GROUP BY folder""",
    "plan_files",
)
def folder_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.folders(views.plan_files(spark, sf_dir))


@query("SELECT folder, count(*) AS n_files FROM plan_files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "plan_files")
def largest_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first folders in the order of plans (all of one level here): a report of ten."""
    rows = views.plan_files(spark, sf_dir).groupBy("folder").agg(F.count(F.lit(1)).alias("n_files")).withColumn("priority", F.lit("medium"))
    return planner.in_order(rows).limit(10).select("folder", "n_files")


@query(
    """WITH ft AS (SELECT o_orderkey AS id, 's' || (o_custkey % 40) AS folder, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS status FROM orders), a AS (SELECT 's' || k AS folder FROM (SELECT DISTINCT o_custkey % 40 AS k FROM orders) WHERE k % 9 = 4),
    m1 AS (SELECT 's' || k AS folder FROM (SELECT DISTINCT o_custkey % 40 AS k FROM orders) WHERE k % 4 = 1), m2 AS (SELECT 's' || k AS folder FROM (SELECT DISTINCT o_custkey % 40 AS k FROM orders) WHERE k IN (2, 6, 38)), m3 AS (SELECT 's' || k AS folder FROM (SELECT DISTINCT o_custkey % 40 AS k FROM orders) WHERE k IN (1, 30)),
    w1 AS (SELECT folder FROM a UNION SELECT folder FROM m1 WHERE EXISTS (SELECT 1 FROM a JOIN m1 USING (folder))), w2 AS (SELECT folder FROM w1 UNION SELECT folder FROM m2 WHERE EXISTS (SELECT 1 FROM w1 JOIN m2 USING (folder))), w3 AS (SELECT folder FROM w2 UNION SELECT folder FROM m3 WHERE EXISTS (SELECT 1 FROM w2 JOIN m3 USING (folder)))
    SELECT id, CASE WHEN folder IN (SELECT folder FROM w3) AND status <> 'in_progress' THEN 'pending' ELSE status END AS status FROM ft"""
)
def reset_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the customers' last numbers; every ninth is affected, and merges of some widen that in their order."""
    t = views.tasks(spark, sf_dir).select("id", F.concat(F.lit("s"), (F.col("folder") % 40).cast("string")).alias("folder"), "status")
    k = views.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("id")).distinct().select("id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("folder"))
    merges = k.filter("id % 4 = 1").select(F.lit("m1").alias("id"), "folder").unionAll(k.filter("id in (2, 6, 38)").select(F.lit("m2"), "folder")).unionAll(k.filter("id in (1, 30)").select(F.lit("m3"), "folder"))
    plan = k.select("folder", F.concat("folder", F.lit("/a.ts")).alias("path"))
    hit = k.filter("id % 9 = 4").select(F.concat("folder", F.lit("/a.ts")).alias("path"))
    return planner.reset_by_folder(t, plan, hit, merges).select("id", "status")


# ---- clusters ---------------------------------------------------------------------------------


@query()
def joined_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined in order until none overlap: no SQL form; tests hold it against a plain loop."""
    cf = views.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey")).alias("cluster"), F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("ord"))
    return clusters.merged(cf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_files"), F.max("parts").alias("parts"))


@query(
    """WITH RECURSIVE r(k, s) AS (SELECT 0, list({'c': c, 'f': f, 'n': CAST(1 AS BIGINT)} ORDER BY c) FROM (SELECT c_nationkey AS c, list(DISTINCT (c_nationkey // 3) || '/' || (c_custkey // 8)) AS f FROM customer GROUP BY 1)
        UNION ALL SELECT k + 1, list_transform(list_filter(range(1, len(s) + 1), lambda x: x <> p.j), lambda x: CASE WHEN x = p.i THEN {'c': s[x].c, 'f': list_distinct(list_concat(s[x].f, s[p.j].f)), 'n': s[x].n + s[p.j].n} ELSE s[x] END)
        FROM (SELECT k, s, list_filter(flatten(list_transform(range(1, len(s) + 1), lambda i: list_transform(range(i + 1, len(s) + 1), lambda j: {'i': i, 'j': j}))), lambda x: len(list_intersect(s[x.i].f, s[x.j].f)) / least(len(s[x.i].f), len(s[x.j].f)) >= 0.3)[1] AS p FROM r) WHERE p IS NOT NULL)
    SELECT u.c AS cluster, unnest(u.f) AS path, u.n AS parts FROM (SELECT unnest(s) AS u FROM r WHERE k = (SELECT max(k) FROM r))"""
)
def joined_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clusters; three neighbours share a file for each eight customers."""
    n = F.col("c_nationkey")
    path = F.concat_ws("/", F.floor(n / 3).cast("string"), F.floor(F.col("c_custkey") / 8).cast("string"))
    return clusters.merged(views.table(spark, sf_dir, "customer").select(n.alias("cluster"), path.alias("path"), n.alias("ord")))


TREE = """d AS (SELECT doc_id AS k, CASE doc_id % 3 WHEN 0 THEN 'a' || (doc_id % 2) WHEN 1 THEN 'a' || (doc_id % 2) || '/b' || (doc_id % 5) ELSE 'a' || (doc_id % 2) || '/b' || (doc_id % 5) || '/c' || (doc_id // 20) END AS dir, CAST(coalesce(length(text), 0) // 4 AS BIGINT) AS tokens FROM documents)"""


@query(
    f"""WITH RECURSIVE {TREE}, o AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM (SELECT dir, sum(tokens) AS tokens, min(k) AS ord FROM d WHERE k % 4 <> 0 GROUP BY 1)),
    s(n, h, dir, best) AS (SELECT CAST(0 AS BIGINT), list({{'c': c, 'o': o, 'd': dir}}), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT 'k' || (k % 13) AS c, CAST(k % 13 AS BIGINT) AS o, dir FROM d WHERE k % 4 = 0)
        UNION ALL SELECT n, CASE WHEN list_contains(list_transform(list_filter(h, lambda x: x.c = best), lambda x: x.d), dir) THEN h ELSE list_append(h, {{'c': best, 'o': coalesce(list_filter(h, lambda x: x.c = best)[1].o, 1000 + n), 'd': dir}}) END, dir, best
        FROM (SELECT n, h, dir, CASE WHEN tokens < 3000 AND len(votes) > 0 THEN list_sort(list_transform(list_distinct(list_transform(votes, lambda x: {{'o': x.o, 'c': x.c}})), lambda y: {{'n': -len(list_filter(votes, lambda x: x.o = y.o)), 'o': y.o, 'c': y.c}}))[1].c ELSE 'orphan:' || dir END AS best
            FROM (SELECT o.n, h, o.dir, o.tokens, list_filter(h, lambda x: x.d = o.dir OR starts_with(x.d, o.dir || '/') OR starts_with(o.dir, x.d || '/')) AS votes FROM s JOIN o ON o.n = s.n + 1)))
    SELECT d.dir || '/f' || k AS path, best AS cluster FROM d JOIN s USING (dir) WHERE k % 4 <> 0""",
)
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of no cluster in a tree of three levels, where what a directory joins decides for those above and below it."""
    k, name = F.col("doc_id"), lambda a, x: F.concat(F.lit(a), x.cast("string"))
    one, two, three = name("a", k % 2), name("b", k % 5), name("c", F.floor(k / 20))
    folder = F.when(k % 3 == 0, one).when(k % 3 == 1, F.concat_ws("/", one, two)).otherwise(F.concat_ws("/", one, two, three))
    rows = views.table(spark, sf_dir, "documents").select(k.alias("ord"), F.concat_ws("/", folder, name("f", k)).alias("path"), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("tokens"))
    held = rows.filter("ord % 4 = 0").select(name("k", F.col("ord") % 13).alias("cluster"), "path", (F.col("ord") % 13).alias("ord"))
    return clusters.orphans(rows.filter("ord % 4 <> 0"), held, 3000)


@query(
    """WITH x AS (SELECT l_suppkey AS cluster, l_orderkey AS path, l_quantity, l_linenumber = 1 AS is_root, row_number() OVER (PARTITION BY l_suppkey, l_linenumber = 1 ORDER BY l_orderkey, l_partkey, l_shipdate, l_linenumber) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey, l_linenumber = 1) AS n, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
    SELECT cluster, CASE WHEN total > 15000 THEN CASE WHEN is_root THEN 0 ELSE CAST(floor(k / greatest(5, ceil(n / 3.0))) AS INT) + 1 END END AS part, count(*) AS n FROM x GROUP BY 1, 2"""
)
def split_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_orderkey").alias("pos"), F.concat_ws("/", "l_partkey", "l_shipdate", "l_linenumber").alias("path"), F.col("l_quantity").alias("tokens"), (F.col("l_linenumber") == 1).alias("is_root"))
    return clusters.split_large(rows, 15_000).groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT l_suppkey AS cluster, count(*) AS n_files, sum(CAST(l_quantity AS BIGINT)) AS tokens FROM lineitem GROUP BY 1) SELECT count(*) AS n_clusters, CAST(sum(n_files) AS BIGINT) AS n_files, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(round(sum(tokens)::DOUBLE / count(*)) AS BIGINT) AS mean FROM c")
def cluster_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"))
    return clusters.cluster_stats(c)


@query("SELECT DISTINCT l_suppkey AS cluster FROM lineitem WHERE l_partkey % 97 = 3")
def affected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cf = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_partkey").alias("path"))
    return book.affected_clusters(cf, cf.select("path").filter("path % 97 = 3"))


@query(
    r"""SELECT l_suppkey AS cluster, l_partkey AS path, CASE WHEN p_partkey IS NULL OR p_partkey % 5 = 0 THEN '—' ELSE coalesce(nullif(CASE WHEN p_size % 4 = 0 THEN '' ELSE 'C' || p_size END, ''), '—') || (CASE WHEN p_size % 3 = 0 THEN ' ✅' ELSE '' END) END AS component,
    CASE WHEN p_partkey IS NULL OR p_partkey % 5 = 0 OR p_size % 2 = 0 THEN '—' ELSE 'useA, useB' END AS hooks, CASE WHEN p_partkey IS NULL OR p_partkey % 5 = 0 THEN '—' WHEN p_size % 2 = 0 THEN 'a, b, c, d, e' ELSE p_brand END AS exports
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey"""
)
def cluster_meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cf = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_partkey").alias("path")).distinct()
    n = F.col("p_size")
    some = lambda *xs: F.array(*map(F.lit, xs))
    meta = views.table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(
        F.col("p_partkey").alias("path"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("C"), n.cast("string"))).alias("component"), F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(some("useA", "useB")).alias("hooks"),
        F.when(n % 2 == 0, some("a", "b", "c", "d", "e", "f")).otherwise(F.array("p_brand")).alias("exports"), (n % 3 == 0).alias("is_component"), F.lit(False).alias("has_jsx"),
    )
    return book.meta_rows(cf, meta)


# ---- pages ------------------------------------------------------------------------------------

MD = "md AS (SELECT doc_id AS k, 'ch-' || (doc_id % 12) || '/doc_' || doc_id || '.md' AS relpath, 'ch-' || (doc_id % 12) AS chapter FROM documents)"
FILES_OF = "pf AS (SELECT DISTINCT relpath, chapter, unnest(['f' || (k % 50) || '.ts', 'f' || (k % 77) || '.ts']) AS path FROM md)"
ISSUE_FILES = "isf AS (SELECT DISTINCT event_id AS id, unnest(['f' || (event_id % 60) || '.ts', 'g' || (event_id % 7) || '.ts']) AS path FROM events)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.page_source(views.md(spark, sf_dir)).join(views.md(spark, sf_dir), "relpath")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    f = lambda a, m: F.concat(F.lit(a), (k % m).cast("string"), F.lit(".ts"))
    return views.table(spark, sf_dir, "events").select(k.alias("id"), F.array(f("f", 60), f("g", 7)).alias("source_files"))


@query(f"WITH {MD} SELECT relpath, chapter, 'Page ' || k AS title, (CASE k % 3 WHEN 0 THEN 'hook' WHEN 1 THEN 'utils' ELSE 'other' END) || ',x' AS tags, 'f' || (k % 50) || '.ts,f' || (k % 77) || '.ts' AS source_files FROM md")
def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.page_source(views.md(spark, sf_dir))
    return rows.select("relpath", "chapter", "title", F.array_join("tags", ",").alias("tags"), F.array_join("source_files", ",").alias("source_files"))


KNOWN = f"""{MD}, sy AS (SELECT relpath, k, unnest([{{'n': 'useThing' || (k % 30), 'p': 0, 't': NULL}}, {{'n': 'Widget' || (k % 40), 'p': 1, 't': NULL}}, {{'n': 'Row' || (k % 20), 'p': 2 + (CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END), 't': 'component'}}, {{'n': 'fn' || (k % 60), 'p': 3 + (CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END), 't': NULL}}]) AS s FROM md),
    sm AS (SELECT relpath, k, s.n AS name, coalesce(s.t, CASE WHEN k % 3 = 0 THEN 'hook' ELSE 'function' END) AS type, 'f' || (k % 50) || '.ts' AS file, s.p AS pos FROM sy UNION ALL SELECT relpath, k, 'More', CASE WHEN k % 3 = 0 THEN 'hook' ELSE 'function' END, 'f' || (k % 50) || '.ts', 2 FROM md WHERE k % 4 = 0)"""


@query(f"WITH {KNOWN} SELECT relpath, name, type, file, pos FROM sm")
def page_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.symbols(_pages(spark, sf_dir))


@query(f"WITH {KNOWN} SELECT name, type, file, relpath FROM sm QUALIFY row_number() OVER (PARTITION BY name ORDER BY relpath, pos) = 1")
def symbol_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.symbol_index(book.symbols(_pages(spark, sf_dir)))


HEADED = f"""{MD}, hd AS (SELECT relpath, 'useThing' || (k % 30) AS name, 'hook' AS type FROM md UNION ALL SELECT relpath, 'Widget' || (k % 40), 'component' FROM md UNION ALL SELECT relpath, 'More', 'component' FROM md WHERE k % 4 = 0)"""


@query(f"WITH {HEADED} SELECT type, count(*) AS n FROM hd GROUP BY 1")
def glossary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.glossary_counts(book.headed_symbols(views.md(spark, sf_dir)))


@query(f"WITH {HEADED}, {FILES_OF} SELECT (SELECT count(DISTINCT chapter) FROM md) AS n_chapters, (SELECT count(*) FROM md) AS n_pages, (SELECT count(*) FROM hd) AS n_symbols, (SELECT count(DISTINCT path) FROM pf) AS n_files")
def book_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.book_figures(_pages(spark, sf_dir), book.headed_symbols(views.md(spark, sf_dir)))


@query(f"WITH {MD}, {FILES_OF}, {ISSUE_FILES} SELECT DISTINCT relpath, id FROM pf JOIN isf USING (path)")
def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of every page: as many rows as there are pairs."""
    return book.page_issue_pairs(_pages(spark, sf_dir), _issues(spark, sf_dir))


@query(f"WITH {MD}, {FILES_OF}, {ISSUE_FILES} SELECT relpath, count(DISTINCT id) AS n_issues FROM pf LEFT JOIN isf USING (path) GROUP BY 1")
def page_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.page_issues(_pages(spark, sf_dir), _issues(spark, sf_dir))


@query(f"WITH {MD}, {FILES_OF}, {ISSUE_FILES} SELECT chapter, count(DISTINCT relpath) AS n_pages, count(DISTINCT path) AS n_files, count(DISTINCT id) AS n_issues FROM pf LEFT JOIN isf USING (path) GROUP BY 1")
def chapter_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.chapter_figures(_pages(spark, sf_dir), _issues(spark, sf_dir))


SETS = "st AS (SELECT id, string_agg(path, ',' ORDER BY path) AS files FROM isf GROUP BY 1)"


@query(f"WITH {MD}, {FILES_OF}, {ISSUE_FILES}, l AS (SELECT DISTINCT id, regexp_replace(relpath, '\\.md$', '') AS link FROM pf JOIN isf USING (path)) SELECT id, row_number() OVER (PARTITION BY id ORDER BY link) - 1 AS place, link, '- [[' || link || ']]' AS line FROM l")
def issue_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of links of every issue, a line a row."""
    return book.issue_links(_pages(spark, sf_dir), _issues(spark, sf_dir))


@query(f"WITH {MD}, {FILES_OF}, {ISSUE_FILES}, {SETS}, l AS (SELECT DISTINCT files, regexp_replace(relpath, '\\.md$', '') AS link FROM pf JOIN isf USING (path) JOIN st USING (id)) SELECT files, row_number() OVER (PARTITION BY files ORDER BY link) - 1 AS place, link, '- [[' || link || ']]' AS line FROM l")
def file_set_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of links, a line a row, for each set of files that issues have."""
    return book.page_links(_pages(spark, sf_dir), _issues(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


@query(f"WITH {ISSUE_FILES}, {SETS} SELECT id, files FROM st")
def issue_file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of files, and so the section, of each issue."""
    return book.file_sets(_issues(spark, sf_dir), "id").withColumn("files", F.array_join("files", ","))


@query(f"WITH {MD} SELECT DISTINCT chapter, CASE WHEN k % 12 < 4 THEN 'Cluster ' || (k % 12) WHEN k % 12 < 8 THEN CAST(k % 12 AS VARCHAR) ELSE CAST(k % 12 AS VARCHAR) END AS label FROM md UNION ALL SELECT 'ch-src_lib_x', 'src/lib/X' UNION ALL SELECT 'ch-a_b', 'a/b'")
def chapter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = views.md(spark, sf_dir).select(F.split("relpath", "/")[0].alias("chapter")).unionAll(spark.createDataFrame([("ch-src_lib_x",), ("ch-a_b",)], "chapter string"))
    known = spark.createDataFrame([(str(k), f"Cluster {k}") for k in range(4)], "id string, label string")
    return book.chapter_labels(chapters, known, spark.createDataFrame([("src/lib/X",), ("7",), ("2",)], "path string"))


@query(f"""WITH {MD}, x AS (SELECT relpath, 'IS-' || (100 + k % 200) || '-HIGH' AS id, 100 + k % 200 AS n, TRUE AS high FROM md UNION ALL SELECT relpath, 'IS-' || (100 + k % 90) || '-LOW', 100 + k % 90, FALSE FROM md) SELECT relpath, id, high AND n - 100 IN (SELECT doc_id % 150 FROM documents) AS resolved FROM x""")
def issue_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.references(views.md(spark, sf_dir), views.issue_names(spark, sf_dir))


@query(
    f"""WITH {MD}, t AS (SELECT k AS id, k % 30 AS folder, relpath, k, CASE k % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'ui-components' WHEN 2 THEN 'cross' WHEN 3 THEN 'hooks' ELSE 'entry' END AS role FROM md WHERE k % 8 <> 7),
    main AS (SELECT * FROM t WHERE role IN ('entry', 'ui-components', 'cross')), f AS (SELECT min(id) AS id FROM main WHERE k % 4 <> 0 AND role = 'entry' GROUP BY folder)
    SELECT id, 0 AS n_referenced, 0 AS n_orphaned, TRUE AS no_section, TRUE AS passed FROM f
    UNION ALL SELECT id, 2, 1 + (CASE WHEN k % 200 IN (SELECT doc_id % 150 FROM documents) THEN 0 ELSE 1 END), FALSE, FALSE FROM main WHERE k % 4 = 0"""
)
def known_issue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of every document is one task's; every eighth task is not done."""
    k = F.col("k")
    t = views.md(spark, sf_dir).select(k.alias("id"), (k % 30).alias("folder"), "relpath", F.when(k % 5 == 1, "ui-components").when(k % 5 == 2, "cross").when(k % 5 == 3, "hooks").otherwise("entry").alias("role"), F.when(k % 8 == 7, "pending").otherwise("completed").alias("status"))
    return book.section_checks(t, views.md(spark, sf_dir).select("relpath", "text"), views.issue_names(spark, sf_dir))


@query(
    """WITH x AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'volume-2-issues/IS-' || doc_id || '-LOW.md' WHEN 1 THEN 'volume-1-code/ch-' || doc_id || '/issues/IS-' || doc_id || '.md' WHEN 2 THEN 'volume-2-issues/ch-01-bugs/IS-' || doc_id || '.md' ELSE 'volume-1-code/issues/IS-' || doc_id || '.md' END AS relpath, doc_id % 4 AS m FROM documents)
    SELECT relpath, CASE m WHEN 0 THEN 'volume-2-root' ELSE 'volume-1-code' END AS location FROM x WHERE m < 2"""
)
def misplaced_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    path = F.when(k % 4 == 0, s("volume-2-issues/IS-", k, "-LOW.md")).when(k % 4 == 1, s("volume-1-code/ch-", k, "/issues/IS-", k, ".md")).when(k % 4 == 2, s("volume-2-issues/ch-01-bugs/IS-", k, ".md")).otherwise(s("volume-1-code/issues/IS-", k, ".md"))
    return book.misplaced(views.table(spark, sf_dir, "documents").select(path.alias("relpath")))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey % 40 < 30 THEN 'ch-c' || (o_custkey % 40) END WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_custkey % 40 < 30 AND o_orderkey % 2 = 0 THEN 'ch-c' || (o_custkey % 40) END
    ELSE CASE WHEN o_custkey % 40 < 30 THEN 'ch-c' || (o_custkey % 40) WHEN o_orderkey % 3 < 2 THEN 'ch-src_lib' END END AS found FROM orders"""
)
def chapter_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty chapters c0 to c29 with a page index.md, and src_lib; tasks name a folder, a file, or a folder that is not there."""
    c, k = F.concat(F.lit("ch-c"), (F.col("o_custkey") % 40).cast("string")), F.col("o_orderkey")
    chapters = spark.range(30).select(F.concat(F.lit("ch-c"), F.col("id").cast("string")).alias("chapter")).unionAll(spark.createDataFrame([("ch-src_lib",)], "chapter string")).withColumn("files", F.array(F.lit("index.md")))
    t = views.table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 == 0, "").when(k % 3 < 2, "Src/lib").otherwise("nowhere").alias("folder"), F.when(k % 5 == 1, F.concat(c, F.when(k % 2 == 0, "/index.md").otherwise("/none.md"))).otherwise(c).alias("chapter"))
    return book.chapter_tasks(chapters, t)


@query("""WITH f AS (SELECT DISTINCT source AS path FROM documents), t AS (SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN source || '-utils' ELSE 'x-' || doc_id END AS id, CASE WHEN doc_id % 3 = 1 THEN source ELSE 'none' END AS folder FROM documents) SELECT path, arg_min(id, ord) AS id FROM f JOIN t ON t.folder = path OR starts_with(t.id, path) GROUP BY 1""")
def folder_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    t = d.select(k.alias("ord"), F.when(k % 3 == 0, F.concat("source", F.lit("-utils"))).otherwise(F.concat(F.lit("x-"), k.cast("string"))).alias("id"), F.when(k % 3 == 1, F.col("source")).otherwise("none").alias("folder"))
    return book.folder_task(d.select(F.col("source").alias("path")), t)


# ---- exports and patterns ---------------------------------------------------------------------


@query(
    """SELECT id, CASE WHEN type IN ('bug','security','typescript','performance','dead_code','complexity','maintainability','ux') THEN type WHEN chapter = 'ch-01-bugs' THEN 'bug' ELSE CASE WHEN chapter LIKE 'ch-0%' THEN 'x' ELSE 'unknown' END END AS type, severity, CASE severity WHEN 'critical' THEN 'P0 - 致命' WHEN 'high' THEN 'P1 - 高' WHEN 'medium' THEN 'P2 - 中' ELSE 'P3 - 低' END AS priority, status, substr(detected_at, 1, 10) AS date, chapter,
    source_file || '; z.ts' AS files, CASE id % 3 WHEN 0 THEN 'what is wrong here' WHEN 1 THEN 'seen' ELSE 'plain' END AS summary FROM issues""",
    "issues",
)
def issue_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.export_rows(_exported(spark, sf_dir)).drop("title", "source")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    body = F.when(k % 3 == 0, "# T\n\n## 问题描述\n\nwhat is\nwrong here\n\n## 检测依据\nno").when(k % 3 == 1, "# T\n## 检测依据\nseen\n---\nx").otherwise("# T\n\nplain\nmore")
    i = views.issues(spark, sf_dir)
    return i.select("id", F.lit("t").alias("title"), "type", "severity", "status", "detected_at", "chapter", F.when(k % 2 == 0, "root").otherwise("chapter").alias("source"), F.array("source_file", F.lit("z.ts")).alias("source_files"), body.alias("body"), F.lit("IS.md").alias("file"))


@query(
    """WITH x AS (SELECT CASE WHEN type IN ('bug','security','typescript','performance','dead_code','complexity','maintainability','ux') THEN type WHEN chapter = 'ch-01-bugs' THEN 'bug' ELSE CASE WHEN chapter LIKE 'ch-0%' THEN 'x' ELSE 'unknown' END END AS type, severity, CASE severity WHEN 'critical' THEN 'P0' WHEN 'high' THEN 'P1' WHEN 'medium' THEN 'P2' ELSE 'P3' END AS priority, chapter, status, CASE WHEN id % 2 = 0 THEN 'root' ELSE 'chapter' END AS source FROM issues)
    SELECT 'type' AS dimension, type AS value, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'chapter', chapter, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM x GROUP BY 2""",
    "issues",
)
def issue_export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.export_summary(registers.export_rows(_exported(spark, sf_dir)))


@query("SELECT path, n FROM (SELECT source_file AS path, count(*) AS n FROM issues GROUP BY 1 UNION ALL SELECT 'z.ts', count(*) FROM issues) ORDER BY n DESC, path LIMIT 20", "issues")
def issue_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.top_files(_exported(spark, sf_dir))


TITLE = r"substr(lower(regexp_replace(p_name, '[^\p{L}\p{N}]', '', 'g')), 1, 60)"


@query(
    rf"""WITH k AS (SELECT *, {TITLE} AS key, 'of ' || p_size || repeat('!', CAST(p_partkey % 4 AS INT)) AS summary FROM part WHERE p_partkey % 6 <> 5), g AS (SELECT p_type AS category, key, count(*) AS n_merged, min(p_partkey) AS ord, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS clusters, count(DISTINCT p_brand) AS nc, arg_max(summary, length(summary) * 1000000000 - p_partkey) AS summary FROM k GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (ORDER BY ord) AS place FROM g), free AS (SELECT x AS number, row_number() OVER (ORDER BY x) AS place FROM range(1, 100000) r(x) WHERE x NOT IN (2, 3, 7))
    SELECT number, 'EXP-' || lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INT, '0') AS id, category, key, summary, clusters, n_merged, CASE WHEN nc >= 2 THEN 'active' ELSE 'candidate' END AS status FROM n JOIN free USING (place)"""
)
def promoted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, some = F.col("p_partkey"), F.array(F.col("p_brand"))
    c = views.table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), F.col("p_type").alias("category"), F.when(k % 6 == 5, "active").otherwise("candidate").alias("status"), F.col("p_name").alias("title"), F.concat(F.lit("of "), F.col("p_size").cast("string"), F.repeat(F.lit("!"), (k % 4).cast("int"))).alias("summary"),
        some.alias("tags"), some.alias("clusters"), some.alias("files"), some.alias("chapters"), F.lit("x").alias("content"), k.alias("ord"),
    )
    out = registers.promote(c, spark.createDataFrame([(2,), (3,), (7,)], "number int"))
    return out.select("number", "id", "category", "key", "summary", F.array_join("clusters", ",").alias("clusters"), "n_merged", "status")


@query("SELECT coalesce(nullif(p_type, ''), 'uncategorized') AS category, count(*) FILTER (p_size % 5 = 0) AS active, count(*) FILTER (p_size % 5 = 1) AS stale, count(*) FILTER (p_size % 5 IN (2, 3)) AS orphaned FROM part WHERE p_size % 5 <> 4 GROUP BY 1")
def pattern_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 5
    status = F.when(n == 0, "active").when(n == 1, "stale").when(n == 2, "orphaned").when(n == 3, "deprecated").otherwise("candidate")
    return registers.pattern_counts(views.table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), status.alias("status")))


@query(
    """WITH f AS (SELECT 'src/' || (CASE doc_id % 6 WHEN 0 THEN 'a[' WHEN 1 THEN 'b{' || '(' WHEN 2 THEN 'isSub=true' WHEN 3 THEN 'x circular: false [' ELSE 'ok' END) || doc_id AS path, doc_id % 6 AS m FROM documents)
    SELECT path, 'mermaid_rect' AS leak, path AS matched FROM f WHERE m IN (0, 3) UNION ALL SELECT path, 'mermaid_diamond', path FROM f WHERE m = 1 UNION ALL SELECT path, 'mermaid_other', path FROM f WHERE m = 1 UNION ALL SELECT path, 'mermaid_edge', 'isSub=true' FROM f WHERE m = 2 UNION ALL SELECT path, 'mermaid_edge', 'circular: false' FROM f WHERE m = 3"""
)
def leaked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.when(k % 6 == 0, "a[").when(k % 6 == 1, "b{(").when(k % 6 == 2, "isSub=true").when(k % 6 == 3, "x circular: false [").otherwise("ok")
    return registers.leaked_names(views.table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), name, k.cast("string")).alias("path")))


@query("SELECT status, count(*) AS n, min(id) AS first FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'pending' WHEN o_orderkey % 7 = 1 THEN 'failed' ELSE CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'in_progress' END END AS status, o_orderkey AS id FROM orders) GROUP BY 1")
def normal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that are not known count as pending."""
    t = views.tasks(spark, sf_dir).withColumn("status", F.when(F.col("id") % 7 == 0, "odd").when(F.col("id") % 7 == 1, "failed").otherwise(F.col("status")))
    rows = t.withColumn("status", tasks.normal_status(F.col("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return rows.orderBy(tasks.status_order(F.col("status")))


# ---- projects ---------------------------------------------------------------------------------


@query(
    """SELECT doc_id AS project, CASE WHEN doc_id % 3 = 0 THEN 'next' WHEN doc_id % 5 = 0 THEN 'react' WHEN doc_id % 7 = 0 THEN 'sveltekit' WHEN doc_id % 11 = 0 THEN 'remix' ELSE 'node' END AS framework, CASE WHEN doc_id % 4 = 0 THEN 'vite' WHEN doc_id % 4 = 1 THEN 'rollup' ELSE 'unknown' END AS build_tool,
    CASE WHEN doc_id % 6 = 0 THEN 'pnpm' WHEN doc_id % 6 = 1 THEN 'yarn' ELSE 'npm' END AS package_manager, CASE WHEN doc_id % 4 = 2 OR doc_id % 9 = 0 OR doc_id % 10 = 3 THEN 'typescript' ELSE 'javascript' END AS language, doc_id % 5 = 0 AS has_jsx, doc_id % 4 = 2 OR doc_id % 9 = 0 OR doc_id % 10 = 3 AS has_typescript FROM documents"""
)
def project_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stands for a project, whose packages and files its number tells."""
    d, k = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    has = lambda c, name: F.when(c, F.struct(F.lit(name).alias("k"), F.lit("1").alias("v")))
    of = lambda *xs: F.map_from_entries(F.array_compact(F.array(*xs)))
    deps = of(has(k % 3 == 0, "next"), has(k % 5 == 0, "react"), has(k % 7 == 0, "@sveltejs/kit"), has(k % 11 == 0, "@remix-run/node"))
    dev = of(has(k % 4 == 0, "vite"), has(k % 4 == 1, "rollup"), has(k % 4 == 0, "esbuild"), has(k % 4 == 2, "typescript"), has(k % 7 == 0, "svelte"))
    names = F.array_compact(F.array(F.lit("package.json"), F.when(k % 6 == 0, "pnpm-lock.yaml"), F.when(k % 6 <= 1, "yarn.lock"), F.when(k % 9 == 0, "tsconfig.json"), F.when(k % 10 == 3, "src/a.tsx"), F.lit("dist/b.ts"), F.lit("a/b/c.ts")))
    return projects.stack(d.select(k.alias("project"), deps.alias("dependencies"), dev.alias("dev_dependencies")), d.select(k.alias("project"), F.explode(names).alias("path")))


@query(
    """SELECT (CASE p WHEN 0 THEN 'packages/' ELSE 'apps/' END) || source AS package, CASE WHEN p = 0 THEN 'named-' || source ELSE source END AS name, n_files FROM (SELECT source, CAST(doc_id % 2 AS INT) AS p, count(*) FILTER (doc_id % 5 < 3) AS n_files FROM documents WHERE doc_id % 5 < 4 GROUP BY 1, 2)"""
)
def repository_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    root = F.concat(F.when(k % 2 == 0, "packages/").otherwise("apps/"), "source")
    name = F.when(k % 5 == 0, "/src/a.ts").when(k % 5 == 1, "/src/x/b.jsx").when(k % 5 == 2, "/src/x/c.js").when(k % 5 == 3, "/src/x/y/d.ts").otherwise("/lib/e.ts")
    files = d.select(F.concat(root, name).alias("path"))
    names = d.select(F.concat(F.lit("packages/"), "source").alias("package"), F.concat(F.lit("named-"), "source").alias("name")).distinct()
    return projects.packages(files, names)


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'issue' WHEN 1 THEN 'wiki,experience' ELSE 'wiki,issue,experience' END AS volumes, count(*) AS n FROM documents GROUP BY 1")
def volume_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 3 == 0, " Issue,odd").when(F.col("doc_id") % 3 == 1, "wiki, EXPERIENCE").when(F.col("doc_id") % 2 == 0, "odd").otherwise(None)
    return views.table(spark, sf_dir, "documents").groupBy(F.array_join(projects.volumes(given), ",").alias("volumes")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'lib/f' || doc_id || (CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.jsx' END) AS path, CASE doc_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status FROM documents WHERE doc_id % 5 = 0")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a comparison of two versions, for the package whose sources lie in packages/a/src."""
    k = F.col("doc_id")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = s("lib/f", k.cast("string"), F.when(k % 2 == 0, ".ts").otherwise(".jsx"))
    path = F.when(k % 5 == 0, s("packages/a/src/", name)).when(k % 5 == 1, s("packages/a/srcx/", name)).when(k % 5 == 2, s("packages/a/src/", k.cast("string"), ".css")).when(k % 5 == 3, s("packages/a/src/node_modules/", name)).otherwise(s("b/", name))
    lines = F.when(k % 3 == 0, s("A\t", path)).when(k % 3 == 1, s("D\t", path)).otherwise(s("R090\told.ts\t", path))
    return book.changed_sources(readers.name_status(views.table(spark, sf_dir, "documents").select(lines.alias("value"))), "packages/a/src")


@query(
    """SELECT project_root, rule, level, passed FROM (SELECT '/p/' || doc_id AS project_root, doc_id AS k, unnest([{'rule': 'PATH-001', 'level': 'CRITICAL', 'passed': doc_id % 6 <> 0}, {'rule': 'PATH-002', 'level': 'CRITICAL', 'passed': doc_id % 4 <> 0}, {'rule': 'PATH-003', 'level': 'CRITICAL', 'passed': doc_id % 5 <> 0},
    {'rule': 'PATH-004', 'level': 'REQUIRED', 'passed': doc_id % 3 <> 0}, {'rule': 'PATH-005', 'level': 'CRITICAL', 'passed': doc_id % 7 <> 0}, {'rule': 'PATH-006', 'level': 'CRITICAL', 'passed': doc_id % 2 <> 0}], recursive := true) FROM documents)"""
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.path_checks(*_roots(spark, sf_dir))


def _roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, k = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    root = F.concat(F.lit("/p/"), k.cast("string"))
    rows = d.select(
        root.alias("project_root"), F.when(k % 6 == 0, root).otherwise("/tool").alias("tool_root"), F.concat(root, F.when(k % 4 == 0, "/out").otherwise("//wiki/")).alias("output_root"),
        F.concat(root, F.when(k % 5 == 0, "x/.cache").otherwise("/.cache")).alias("cache_root"), F.when(k % 3 == 0, root).otherwise(F.concat(root, F.lit("/./src"))).alias("source_root"),
    )
    names = F.array_compact(F.array(F.when((k % 7 != 0) & (k % 14 < 9), "package.json"), F.when((k % 7 != 0) & (k % 14 >= 9), "src"), F.lit("agents.md"), F.when(k % 2 == 0, "skills"), F.lit("x")))
    return rows, d.select(root.alias("root"), F.explode(names).alias("path"))


@query(
    """SELECT '/p/' || doc_id AS project_root, (CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS critical_failed, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS required_failed,
    doc_id % 2 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS passed FROM documents"""
)
def path_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.path_verdicts(registers.path_checks(*_roots(spark, sf_dir)))


@query("""WITH n AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(o_orderpriority, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_') AS x, o_orderpriority AS name FROM orders) SELECT name, x AS node, lower(x) AS folder, trim(regexp_replace(lower(replace(x, '_', '-')), '-+', '-', 'g'), '-') AS cluster FROM n""")
def derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("name")
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct().select("name", paths.node_id(c).alias("node"), paths.folder_key(c).alias("folder"), clusters.cluster_id(c).alias("cluster"))


@query("""SELECT o_orderkey AS id, '# ' || o_orderkey || chr(10) || chr(10) || '## Files' || chr(10) || chr(10) || coalesce((SELECT string_agg('- `' || k || '`', chr(10) ORDER BY k) FROM (SELECT DISTINCT l_partkey::VARCHAR AS k FROM lineitem WHERE l_orderkey = o_orderkey)), '') || chr(10) || chr(10) || '## Budget' || chr(10) || chr(10) || '15,000 tokens' || chr(10) || chr(10) || '## Issue numbers' || chr(10) || chr(10) || 'IS-' || lpad((10 * o_orderkey)::VARCHAR, greatest(4, length((10 * o_orderkey)::VARCHAR))::INT, '0') || ' to IS-' || lpad((10 * o_orderkey + 9)::VARCHAR, greatest(4, length((10 * o_orderkey + 9)::VARCHAR))::INT, '0') || chr(10) || chr(10) || '## Output' || chr(10) || chr(10) || 'ch-' || o_custkey || chr(10) AS text FROM orders WHERE o_orderstatus <> 'F'""")
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "skip").otherwise("run").alias("action"), F.lit(15_000).alias("budget"), (10 * F.col("o_orderkey")).alias("issue_from"), F.concat(F.lit("ch-"), F.col("o_custkey").cast("string")).alias("chapter"))
    f = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("path")).distinct()
    return render.prompts(o, f)


@query("SELECT o_orderkey || '.md' AS name FROM orders WHERE o_orderstatus <> 'F'")
def kept_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "skip").otherwise("run").alias("action"))
    return render.kept_prompts(o.select(F.concat("id", F.lit(".md")).alias("name")), o)


@query("SELECT 'internal' AS kind, node FROM (SELECT 'a/lib/' || doc_id AS node FROM documents WHERE doc_id % 4 = 0) UNION ALL SELECT DISTINCT 'external_dependency', 'b/' || (doc_id // 3) FROM documents WHERE doc_id % 4 = 0 AND (doc_id // 3) % 4 <> 0 UNION ALL SELECT DISTINCT 'external_dependent', 'b/' || doc_id FROM documents WHERE doc_id % 4 <> 0 AND (doc_id // 3) % 4 = 0")
def folder_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that is not there by its whole name, but by its last segment."""
    k = F.col("doc_id")
    name = lambda x: F.concat(F.when(x % 4 == 0, "a/lib/").otherwise("b/"), x.cast("string"))
    e = views.table(spark, sf_dir, "documents").select(name(k).alias("src"), name(F.expr("doc_id div 3")).alias("dst")).filter("src <> dst").distinct()
    return graph.folder_graph(e, "src/lib")


# ---- more of sources, classes and checks ------------------------------------------------------


@query(
    """WITH f AS (SELECT 'src/a' || (doc_id % 7) || '/f' || doc_id || (CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END) AS path, doc_id FROM documents), e AS (SELECT path AS src, doc_id FROM f WHERE doc_id % 3 < 2)
    SELECT src, CASE doc_id % 4 WHEN 0 THEN '../a' || ((doc_id // 2) % 7) || '/f' || (doc_id // 2) WHEN 1 THEN '@/a' || ((doc_id // 3) % 7) || '/f' || (doc_id // 3) WHEN 2 THEN 'react' ELSE './none' || doc_id END AS specifier, d.path AS dst, CASE WHEN d.path IS NULL THEN 'external' ELSE 'local' END AS type
    FROM e LEFT JOIN f d ON d.doc_id = CASE e.doc_id % 4 WHEN 0 THEN e.doc_id // 2 WHEN 1 THEN e.doc_id // 3 END""".replace("SELECT src, CASE doc_id % 4", "SELECT src, CASE e.doc_id % 4").replace("(doc_id // 2)", "(e.doc_id // 2)").replace("(doc_id // 3)", "(e.doc_id // 3)").replace("'./none' || doc_id", "'./none' || e.doc_id")
)
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    files = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(s("src/a", k % 7, "/f", k), F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.js")).alias("path"))
    half, third = F.expr("doc_id div 2"), F.expr("doc_id div 3")
    to = F.when(k % 4 == 0, s("../a", half % 7, "/f", half)).when(k % 4 == 1, s("@/a", third % 7, "/f", third)).when(k % 4 == 2, "react").otherwise(s("./none", k))
    contents = files.filter("doc_id % 3 < 2").select("path", F.concat(F.lit("import x from '"), to, F.lit("'\nconst y = 1")).alias("content"))
    edges = readers.import_edges(contents).select("src", "specifier")
    return readers.resolved_imports(edges, files, {"@/": "src/"})


@query(
    r"""WITH r AS (SELECT DISTINCT doc_id AS page, doc_id + d AS path, unnest([string_split(text, ' ')[3], substr(string_split(text, ' ')[5], 1, 4), string_split(text, ' ')[7][:-2] || ' ' || string_split(text, ' ')[8], 'the']) AS symbol FROM documents, range(2) x(d))
    SELECT page, path, symbol, coalesce(regexp_matches(text, '\b' || regexp_replace(symbol, '([\]\[.*+?^$(){}|\\])', '\\\1', 'g') || '\b'), false) AS found FROM r LEFT JOIN documents ON doc_id = path WHERE symbol <> ''"""
)
def symbol_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, parts of words and runs of two from a text, looked for in that text and in the next."""
    w = lambda n: F.try_element_at(F.split("text", " "), F.lit(n))
    symbols = F.array(w(3), F.substring(w(5), 1, 4), F.concat(F.expr("left(try_element_at(split(text, ' '), 7), greatest(0, length(try_element_at(split(text, ' '), 7)) - 1))"), F.lit(" "), w(8)), F.lit("the"))
    d = views.table(spark, sf_dir, "documents")
    refs = d.select(F.col("doc_id").alias("page"), F.explode(symbols).alias("symbol")).select("page", F.explode(F.array("page", F.col("page") + 1)).alias("path"), "symbol")
    return registers.symbol_checks(refs.filter("symbol <> ''").distinct(), d.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("SELECT 'p' || doc_id AS relpath, f AS field, CASE f WHEN 'source' THEN 'error' ELSE 'warning' END AS severity FROM documents, (VALUES ('tags', 3), ('updated', 4), ('source', 5)) v(f, m) WHERE doc_id % m = 0")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of every document, and beside these an issue's or a written page of every fourth, which are not asked."""
    k = F.col("doc_id")
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    other = F.when(k % 8 == 0, s("volume-2-issues/p", k, ".md")).when(k % 8 == 1, s("ch-", k, "/glossary.md"))
    names = F.explode(F.array_compact(F.array(s("p", k), other)))
    pages = views.table(spark, sf_dir, "documents").select(names.alias("relpath"), F.when(k % 3 == 0, "").otherwise("x").alias("tags"), F.when(k % 4 != 0, "2024").alias("updated"), F.when(k % 5 != 0, "a.ts").alias("source"))
    return registers.missing_fields(pages, {"tags": "warning", "updated": "warning", "source": "error"})


@query("SELECT DISTINCT page, target FROM (SELECT 'ch-' || (doc_id % 12) || '/doc_' || doc_id || '.md' AS page, unnest(['doc_' || (doc_id % 400), 'doc_' || (doc_id * 3), 'Z ' || (doc_id % 5)]) AS target FROM documents) WHERE target NOT IN (SELECT 'doc_' || doc_id FROM documents)")
def broken_wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of page bodies, with names to show and white space around."""
    k = F.col("k").cast("string")
    more = F.concat(F.col("text"), F.lit("[[ doc_"), (F.col("k") * 3).cast("string"), F.lit(" | shown]] [[\tZ "), (F.col("k") % 5).cast("string"), F.lit(" ]] [[Z "), (F.col("k") % 5).cast("string"), F.lit("|"), k, F.lit("]]"))
    pages = views.md(spark, sf_dir).select("relpath", F.regexp_replace(more, "\\nsourceFiles", "\nlink: '[[front]]'\nsourceFiles").alias("text"))
    return registers.broken_links(registers.wiki_links(pages), pages)


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'src/b' || event_id || '.ts:' || (event_id % 90) WHEN 1 THEN 'src/c.tsx:7' WHEN 2 THEN 'src/d' || event_id || '.js' ELSE '' END AS place, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 90 WHEN 1 THEN 7 WHEN 2 THEN event_id % 90 END AS INT) AS line FROM events")
def issue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    n, m = k.cast("string"), (k % 90).cast("string")
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    text = F.when(k % 4 == 0, s("## 检测依据\n- **位置**：`src/b", n, ".ts:", m, "` — `Button`\n")).when(k % 4 == 1, s("- **位置**：`src/c.tsx:7`\nand `e.ts:9`")).when(k % 4 == 2, s("see `src/d", n, ".js:", m, "` there")).otherwise(s("none ", n))
    place, line = registers.issue_place(text)
    return views.table(spark, sf_dir, "events").select(k.alias("id"), place.alias("place"), line.alias("line"))


@query(
    """WITH p AS (SELECT doc_id AS d, 'a' || (doc_id % 3) || '/b' || (doc_id % 5) || '/' || (CASE WHEN doc_id % 11 = 0 THEN 'tmp/' ELSE '' END) || (CASE WHEN doc_id % 7 = 0 THEN 'keep' ELSE 'f' END) || doc_id || (CASE doc_id % 4 WHEN 0 THEN '.log' WHEN 1 THEN '.tmp' ELSE '.ts' END) AS path FROM documents)
    SELECT path FROM p WHERE NOT (d % 3 = 1 AND d % 5 = 2) AND d % 5 <> 4 AND NOT (d % 11 = 0 AND d % 4 > 1) AND NOT (CASE WHEN d % 3 = 0 AND d % 4 > 1 THEN d % 7 <> 0 AND d % 10 = 7 WHEN d % 3 = 0 AND d % 4 = 0 THEN d % 7 <> 0 AND d % 5 = 1 ELSE d % 4 = 0 AND d % 7 <> 0 END)"""
)
def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that ignore files of three folders leave: exceptions, folders, anchors and a deeper file that decides."""
    d = F.col("doc_id")
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") if x is d else x for x in parts])
    path = s("a", (d % 3).cast("string"), "/b", (d % 5).cast("string"), "/", F.when(d % 11 == 0, "tmp/").otherwise(""), F.when(d % 7 == 0, "keep").otherwise("f"), d, F.when(d % 4 == 0, ".log").when(d % 4 == 1, ".tmp").otherwise(".ts"))
    texts = spark.createDataFrame([("", "# all\n*.log\n!keep*.log\n/a1/b2/\nb4/\n**/tmp/*.ts\nb9\n"), ("a0", "!*.log\nf*7.ts  \n\\#x\n"), ("a0/b1", "f*[0-9].log\n")], "folder string, text string")
    return ignores.kept(views.table(spark, sf_dir, "documents").select(path.alias("path")), ignores.rules(texts))


@query(
    """WITH e AS (SELECT p.page_id // 100 AS project, 'src/p' || page_id || '.ts' AS src, page_id AS k, page_id % 100 AS m FROM pages p), n AS (SELECT *, (k // 100) * 100 + (m * 7) % 100 AS o FROM e)
    SELECT src, CASE m % 5 WHEN 0 THEN '@/p' || o WHEN 1 THEN '@/deep/p' || o || '.x' WHEN 2 THEN 'one' WHEN 3 THEN './p' || o ELSE 'react' END AS specifier, CASE WHEN m % 5 IN (0, 3) AND o IN (SELECT k FROM e) THEN 'src/p' || o || '.ts' WHEN m % 5 = 1 AND o IN (SELECT k FROM e) THEN 'src/p' || o || '.ts' WHEN m % 5 = 2 AND project * 100 IN (SELECT k FROM e) THEN 'src/p' || (project * 100) || '.ts' END AS dst FROM n""",
)
def pattern_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by patterns of their project's settings: the longest beginning, an exact name, several targets."""
    k = F.col("page_id")
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    project, m = F.floor(k / 100), k % 100
    other = project * 100 + (m * 7) % 100
    pages = views.table(spark, sf_dir, "pages")
    text = s('{"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["gone/*", "./*"], "@/deep/*.x": ["*"], "one": ["p', F.col("project") * 100, '"], "@/dee*": ["nowhere/*"]}}}')
    settings = pages.select(project.alias("project")).distinct().select("project", text.alias("text"))
    spec = F.when(m % 5 == 0, s("@/p", other)).when(m % 5 == 1, s("@/deep/p", other, ".x")).when(m % 5 == 2, "one").when(m % 5 == 3, s("./p", other)).otherwise("react")
    edges = pages.select(project.alias("project"), s("src/p", k, ".ts").alias("src"), spec.alias("specifier"))
    return readers.resolved_imports(edges, edges.select(F.col("src").alias("path")), patterns=readers.path_patterns(settings)).select("src", "specifier", "dst")


@query(
    """WITH e AS (SELECT 'f' || src || '.ts' AS src, CASE WHEN dst % 4 = 0 THEN 'lib' || dst WHEN dst % 9 = 5 THEN 'pkg' || dst ELSE 'f' || dst || '.ts' END AS dst, src % 5 = 0 AS circular, dst % 4 <> 0 AND dst % 9 <> 5 AS near FROM circles), m AS (SELECT src AS source FROM e UNION SELECT dst FROM e WHERE near), c AS (SELECT src AS source FROM e WHERE circular UNION SELECT dst FROM e WHERE circular),
    d AS (SELECT dst AS source, count(*) AS n FROM e GROUP BY 1) SELECT source, source IN (SELECT source FROM c) AS has_circular, coalesce(n, 0) AS n_dependents FROM m LEFT JOIN d USING (source)""",
    "circles",
)
def analysed_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analyser prints, a document for some modules, to a graph with dependents."""
    t, f = F.col("dst"), lambda x: F.concat(F.lit("../work/src/f"), x.cast("string"), F.lit(".ts"))
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    dep = F.when(t % 4 == 0, s('{"resolved": "../work/node_modules/lib', t, '/i.js", "module": "lib', t, '", "moduleName": "lib', t, '"')).when(t % 9 == 5, s('{"couldNotResolve": true, "module": "pkg', t, '"')).otherwise(s('{"couldNotResolve": false, "resolved": "', f(t), '"'))
    dep = s(dep, F.when(F.col("src") % 5 == 0, F.when(F.col("src") % 2 == 0, ', "cycle": true').otherwise(', "circular": true')).otherwise(""), "}")
    modules = views.circles(spark, sf_dir).select("src", dep.alias("d")).groupBy("src").agg(s('{"source": "', f(F.col("src")), '", "dependencies": [', F.array_join(F.sort_array(F.collect_list("d")), ","), "]}").alias("m"))
    more = F.lit('{"source": "../work/node_modules/x.js", "dependencies": [{"resolved": "../work/src/f1.ts"}]}')
    raw = modules.groupBy((F.col("src") % 50).alias("g")).agg(s('{"modules": [', F.array_join(F.array_append(F.sort_array(F.collect_list("m")), more), ","), "]}").alias("text"))
    _, edges, _ = readers.analysis(raw, "../work/src")
    return graph.build(edges)[0].select("source", "has_circular").join(graph.dependents(edges), "source", "left").na.fill(0, ["n_dependents"])


@query("SELECT o_orderkey AS id, CASE WHEN bool_and(l_quantity >= 10) THEN 'verified' ELSE 'disputed' END AS verdict FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def issue_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") >= 10).alias("passed"))
    return registers.verdicts(checks.join(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi"))


@query("WITH e AS (SELECT src, dst, src % 5 = 0 AS circular, CASE WHEN dst % 4 = 0 THEN 'external' ELSE 'local' END AS type FROM circles), m AS (SELECT src AS source FROM e UNION SELECT dst FROM e WHERE type = 'local'), c AS (SELECT src AS source FROM e WHERE circular UNION SELECT dst FROM e WHERE circular) SELECT source, source IN (SELECT source FROM c) AS has_circular FROM m", "circles")
def module_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.circles(spark, sf_dir).select("src", "dst", F.when(F.col("dst") % 4 == 0, "external").otherwise("local").alias("type"), (F.col("src") % 5 == 0).alias("circular"), F.col("src").alias("ord"))
    return graph.build(e)[0].select("source", "has_circular")


@query("SELECT o_orderkey AS k, 'IS-' || o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'bug' ELSE 'ux' END AS type, CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'low' END AS severity, 'a' || o_custkey || '.ts' AS source_files FROM orders")
def table_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues written as tables: back quotes, signs and case are not part of values."""
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("# T\n\n| **ID** | IS-"), k.cast("string"), F.lit(" |\n| **Type** | `"), F.when(k % 2 == 0, "bug").otherwise("ux"), F.lit("` |\n| **Severity** | 🔴 "), F.when(k % 3 == 0, "HIGH").otherwise("Low"), F.lit(" |\n| **Source** | a"), F.col("o_custkey").cast("string"), F.lit(".ts |\n"))
    rows = views.table(spark, sf_dir, "orders").select(k.alias("k"), readers.parse_issue(raw).alias("i"))
    return rows.select("k", "i.id", "i.type", "i.severity", F.array_join("i.source_files", ",").alias("source_files"))


@query(
    """WITH a AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'a' || o_orderkey || '.json' WHEN 1 THEN 'b' || o_orderkey || '.md' ELSE 'c' || o_orderkey || '/state.json' END AS name, o_orderkey % 6 AS m FROM orders), p AS (SELECT name, o_custkey % 2 = 0 AS critical, CASE WHEN m2 = 0 THEN 'empty' WHEN m2 = 1 AND name LIKE '%.json' THEN 'invalid' WHEN m2 = 2 AND name LIKE 'a%' THEN 'ghost' WHEN m2 = 5 THEN 'missing' END AS problem FROM (SELECT *, o_custkey % 7 AS m2 FROM a))
    SELECT name, problem, CASE problem WHEN 'invalid' THEN 'error' WHEN 'ghost' THEN 'warning' WHEN 'empty' THEN CASE WHEN critical THEN 'error' ELSE 'warning' END WHEN 'missing' THEN CASE WHEN critical THEN 'error' ELSE 'warning' END END AS severity FROM p"""
)
def artifact_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("o_orderkey"), F.col("o_custkey") % 7
    n = k.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("a"), n, F.lit(".json"))).when(k % 3 == 1, F.concat(F.lit("b"), n, F.lit(".md"))).otherwise(F.concat(F.lit("c"), n, F.lit("/state.json")))
    long_ = F.concat(F.lit('"'), F.repeat(F.lit("x"), 220), F.lit('"'))
    some = lambda n: F.concat(F.lit("["), F.array_join(F.array(*[long_] * n), ","), F.lit("]"))
    text = F.when(m == 0, "").when(m == 1, "{").when(m == 2, some(3)).when(m == 3, some(1)).when(m == 4, " \n").when(m == 5, None).otherwise("null")
    return registers.artifact_gate(views.table(spark, sf_dir, "orders").select(name.alias("name"), text.alias("text"), (F.col("o_custkey") % 2 == 0).alias("critical")))


@query(
    """SELECT o_orderkey AS id, CASE m WHEN 0 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS n_pages, m IN (0, 3) AS is_empty, m IN (2, 3, 4) AS marked, CASE m WHEN 0 THEN FALSE WHEN 1 THEN done WHEN 2 THEN TRUE WHEN 3 THEN FALSE WHEN 4 THEN TRUE ELSE done END AS passed,
    CASE m WHEN 0 THEN CASE WHEN done THEN 'missing' END WHEN 1 THEN CASE WHEN NOT done THEN 'no marker' END WHEN 3 THEN 'empty page' WHEN 4 THEN CASE WHEN NOT done THEN 'short page' END WHEN 5 THEN 'marker incomplete' END AS problem FROM (SELECT o_orderkey, o_orderkey % 6 AS m, o_orderstatus = 'F' AS done FROM orders)"""
)
def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, m = views.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    folder = F.concat(F.lit("ch-"), F.col("o_orderkey").cast("string"))
    t = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"), F.when(m == 2, F.concat(folder, F.lit("/sec.md"))).otherwise(folder).alias("chapter"))
    file = lambda when, name, size, text: F.when(when, F.struct(F.lit(name).alias("name"), F.lit(size).alias("size"), F.lit(text).alias("text")))
    full = "subagent: completed\ngenerated_at: 2024\n"
    names = F.array_compact(F.array(file(m.isin(1, 2, 5), "sec.md", 900, None), file(m == 3, "sec.md", 0, None), file(m == 4, "sec.md", 9, None), file(m == 5, "two.md", 900, None), file(m.isin(2, 3, 4), ".gen-done", 9, full), file(m == 5, ".gen-done", 9, "subagent: completed")))
    out = o.select(folder.alias("folder"), F.explode(names).alias("f")).select("folder", "f.*")
    return registers.output_checks(t, out)


@query("SELECT doc_id, doc_id % 4 <> 3 AND doc_id % 4 <> 1 AS wide, doc_id % 4 = 0 AS narrow FROM documents")
def barrel_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two readings of a file of re-exports: the wide one takes lines of comments that begin with a star."""
    k = F.col("doc_id") % 4
    base = "export * from './a'\n\n// x\nexport { a } from './b'\nexport type { T } from './c'\n'use client'"
    text = F.when(k == 0, base).when(k == 1, base + "\nconst x = 1").when(k == 2, base + "\n/*\n * y").otherwise(F.concat(F.lit(base), F.lit("\n"), F.repeat(F.lit("// z\n"), 1500), F.lit("x()")))
    text = F.when(k == 3, F.concat(F.lit(base + "\nx()\n"), F.repeat(F.lit("// z\n"), 9))).otherwise(text)
    return views.table(spark, sf_dir, "documents").select("doc_id", code.is_barrel(text).alias("wide"), code.is_barrel(text, 4096, False).alias("narrow"))


@query("SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'dead_code' WHEN 2 THEN 'bug' WHEN 3 THEN 'zz' WHEN 4 THEN 'typescript' ELSE 'unknown' END AS type, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'unknown' END AS severity, CASE event_id % 4 WHEN 0 THEN 'P0 - 致命' WHEN 1 THEN 'P3 - 低' WHEN 2 THEN 'P1 - 高' ELSE 'odd' END AS priority, CASE event_id % 6 WHEN 1 THEN 'P2' WHEN 2 THEN 'P0' WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE 'P1' END AS tier FROM events")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the name, the chapter, the file, or the name as it is."""
    k = F.col("event_id")
    t = registers.type_name(
        F.when(k % 6 == 0, "Type-Safety ").when(k % 6 == 3, "ZZ").when(k % 6 == 5, None).otherwise("odd"), F.when(k % 6 == 1, "ch-05-dead-code"), F.when(k % 6 == 2, "IS-1-logic-error.md").when(k % 6 == 4, "is-naming-2.md").otherwise("x.md"),
    )
    raw = F.when(k % 4 == 0, "P0").when(k % 4 == 1, "Info").when(k % 4 == 2, "major").otherwise("odd")
    rows = views.table(spark, sf_dir, "events").select(k.alias("id"), t.alias("type"), registers.severity_name(raw).alias("severity"), registers.priority_name(raw).alias("priority"))
    return rows.withColumn("tier", registers.tier_of(F.col("type")))


@query("SELECT doc_id AS k, CASE WHEN doc_id % 5 IN (0, 4) THEN 'local' ELSE 'external' END AS type, CASE doc_id % 5 WHEN 0 THEN 'src/f' || doc_id || '.ts' WHEN 1 THEN 'react' WHEN 2 THEN 'gone' WHEN 3 THEN 'bare' ELSE 'q' END AS target FROM documents")
def dependency_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    target = readers.dependency_target(
        F.when(k % 5 == 0, F.concat(F.lit("src\\f"), k.cast("string"), F.lit(".ts"))).when(k % 5 == 1, "node_modules/react/index.js"), F.when(k % 5 == 2, "gone"), F.when(k % 5 == 1, "react"), F.when(k % 5 == 3, "bare").when(k % 5 == 4, "./q"),
    )
    return views.table(spark, sf_dir, "documents").select(k.alias("k"), target.alias("t")).select("k", "t.type", "t.target")


@query(
    """WITH x AS (SELECT l_suppkey AS cluster, CASE l_partkey % 7 WHEN 0 THEN 'lib' ELSE 'd' || (l_partkey % 3) END AS seg, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)), s AS (SELECT cluster, count(*) AS size FROM x GROUP BY 1), n AS (SELECT cluster, seg AS segment, count(*) AS n, min('src/' || seg || '/' || l_partkey) AS f FROM x WHERE seg <> 'lib' GROUP BY 1, 2),
    b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1) SELECT cluster, segment, n FROM b JOIN s USING (cluster) WHERE n >= greatest(1, round(size * 0.3::DOUBLE))"""
)
def majority_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    path = F.concat(F.lit("src/"), F.when(k % 7 == 0, "lib").otherwise(F.concat(F.lit("d"), (k % 3).cast("string"))), F.lit("/"), k.cast("string"))
    return clusters.majority_directory(views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), path.alias("path")).distinct(), ["src", "lib"])


@query(
    """WITH h AS (SELECT DISTINCT l_suppkey AS cluster, 'd' || (l_partkey % 9) || '/e' || (l_partkey % 4) || '/' || (l_partkey // 50) AS dir FROM lineitem), o AS (SELECT DISTINCT unnest(['d' || (p_partkey % 9), 'd' || (p_partkey % 9) || '/e1/' || (p_partkey // 50) || '/x', p_brand]) AS dir FROM part),
    p AS (SELECT o.dir, cluster, count(*) AS overlap FROM o JOIN h ON o.dir = h.dir OR starts_with(o.dir, h.dir || '/') OR starts_with(h.dir, o.dir || '/') GROUP BY 1, 2) SELECT dir, cluster, overlap FROM p QUALIFY row_number() OVER (PARTITION BY dir ORDER BY overlap DESC, cluster) = 1"""
)
def orphan_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of parts above and below those of the suppliers' parts, and some that are nowhere."""
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    k, p = F.col("l_partkey"), F.col("p_partkey")
    held = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_suppkey").alias("ord"), s("d", k % 9, "/e", k % 4, "/", F.expr("l_partkey div 50")).alias("dir"))
    dirs = F.array(s("d", p % 9), s("d", p % 9, "/e1/", F.expr("p_partkey div 50"), "/x"), F.col("p_brand"))
    return clusters.orphan_homes(views.table(spark, sf_dir, "part").select(F.explode(dirs).alias("dir")), held)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' AND o_custkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'completed' ELSE CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'pending' END END AS status, o_orderstatus <> 'F' AND o_custkey % 3 = 0 AND o_custkey % 2 = 1 AS blocked FROM orders")
def synced_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of every third number are there; of these the odd ones name issues without a file."""
    o = views.table(spark, sf_dir, "orders")
    c = F.concat(F.lit("ch-"), F.col("o_custkey").cast("string"))
    t = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("pending").alias("status"), c.alias("chapter"))
    found = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, c).alias("found"))
    return tasks.synced(t, found, o.filter("o_custkey % 2 = 1").select(c.alias("chapter"))).select("id", "status", "blocked")


# ---- reports, a line a row --------------------------------------------------------------------

SEV = "CASE severity WHEN 'critical' THEN '⛔' WHEN 'high' THEN '🔴' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🟢' ELSE '⚪' END"
SEV_PLACE = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 99 END"


def _lines(*parts: tuple[str, str, str, str, str, str, list[str]]) -> str:
    """SQL of numbered lines: for each part its table, section, group, kind, place and name, and the lines of a row."""
    each = [f"SELECT {s} AS s, CAST({a} AS VARCHAR) AS a, {g} AS g, {p} AS p, CAST({b} AS VARCHAR) AS b, unnest(range({len(lines)})) AS n, unnest([{', '.join(lines)}]) AS line FROM {t}" for t, s, a, g, p, b, lines in parts]
    return f"SELECT row_number() OVER (ORDER BY s, a, g, p, b, n) - 1 AS place, line FROM ({' UNION ALL '.join(each)})"


def _q(*lines: str) -> list[str]:
    return [f"'{x}'" for x in lines]


SHARE = "CASE WHEN total = 0 THEN '—' ELSE regexp_replace(CAST(floor({0} * 1000 / total + 0.5) / 10 AS VARCHAR), '\\.0$', '') || '%' END"
BAR = "repeat('█', CAST(round_even({1} * {0} / total, 0) AS INT)) || repeat('░', {1} - CAST(round_even({1} * {0} / total, 0) AS INT))"
STATES = {"completed": "✅", "in_progress": "🔄", "pending": "⏳", "failed": "❌"}
STATE_MARK = f"CASE status {' '.join(f"WHEN '{k}' THEN '{m}'" for k, m in STATES.items())} END"
STATE_PLACE = "CASE status WHEN 'failed' THEN '0' WHEN 'in_progress' THEN '1' WHEN 'pending' THEN '2' ELSE '3' END"


@query(
    f"""WITH f AS (SELECT folder, count(*) AS total, CAST(sum(tokens) AS BIGINT) AS tokens, {', '.join(f"count(*) FILTER (status = '{k}') AS {k}" for k in STATES)} FROM tasks GROUP BY 1), r AS (SELECT *, total AS n_files, CASE WHEN failed > 0 THEN 'failed' WHEN in_progress > 0 THEN 'in_progress' WHEN pending > 0 THEN 'pending' ELSE 'completed' END AS status FROM f),
    one AS (SELECT CAST(sum(total) AS BIGINT) AS total, {', '.join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in STATES)} FROM r), kinds AS (SELECT status, count(*) AS n FROM r GROUP BY 1)
    """ + _lines(
        ("one", "0", "''", "0", "0", "''", _q("---", "phase: GEN", "---", "", "# Progress")),
        ("one", "1", "''", "0", "0", "''", [*_q("", "## Total", "", "| state | n | share |", "|---|---|---|"), *[f"'| {m} {k} | ' || {k} || ' | ' || {SHARE.format(k)} || ' |'" for k, m in STATES.items()], "''", f"{BAR.format('completed', 40)} || ' ' || {SHARE.format('completed')}"]),
        ("kinds", "2", STATE_PLACE, "0", "0", "''", ["''", f"'## ' || {STATE_MARK} || ' ' || status || ' (' || n || ')'", *_q("", "| folder | files | tokens | tasks | done | state |", "|---|---|---|---|---|---|")]),
        ("r", "2", STATE_PLACE, "1", "folder", "''", [f"'| `' || folder || '` | ' || n_files || ' | ' || format('{{:,}}', tokens) || ' | ' || total || ' | ' || completed || ' | ' || {STATE_MARK} || ' ' || {BAR.format('completed', 10)} || ' |'"]),
    ),
    "tasks",
)
def report_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tasks(spark, sf_dir)
    more = t.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("tokens").alias("tokens"))
    return render.numbered(render.progress(tasks.status_counts(t, ["folder"]).join(more, "folder")))


@query(
    f"""WITH {HEADED}, k AS (SELECT *, CASE type WHEN 'component' THEN '00' WHEN 'hook' THEN '01' ELSE '99' END || type AS k FROM hd), c AS (SELECT k, type, count(*) AS n FROM k GROUP BY 1, 2), one AS (SELECT count(*) AS n FROM hd) """ + _lines(
        ("one", "0", "''", "0", "0", "''", ["'---'", "'total_symbols: ' || n", *_q("---", "", "# Glossary")]), ("one", "1", "''", "0", "0", "''", _q("", "## Types", "", "| type | n |", "|---|---|")),
        ("c", "2", "k", "0", "0", "''", ["'| ' || type || ' | ' || n || ' |'"]), ("c", "3", "k", "0", "0", "''", ["''", "'## ' || type", *_q("", "| name | page |", "|---|---|")]),
        ("k", "3", "k", "1", "0", "name || chr(1) || relpath", ["'| `' || name || '` | [[' || regexp_replace(relpath, '\\.md$', '') || ']] |'"]),
    )
)
def report_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.numbered(render.glossary(book.headed_symbols(views.md(spark, sf_dir))))


@query(
    f"""WITH i AS (SELECT f AS path, id, type, severity FROM (SELECT id, type, severity, unnest([coalesce(source_file, 'none'), 'all-' || (id % 5)]) AS f FROM issues WHERE type IS NOT NULL)), sv AS (SELECT severity, count(*) AS n FROM issues GROUP BY 1), one AS (SELECT (SELECT count(*) FROM issues) AS n, count(DISTINCT path) AS files FROM i) """ + _lines(
        ("one", "0", "''", "0", "0", "''", ["'---'", "'issues: ' || n", "'files: ' || files", *_q("---", "", "# Files and issues")]), ("one", "1", "''", "0", "0", "''", _q("", "## Severity", "", "| severity | n |", "|---|---|")),
        ("sv", "2", "''", "0", SEV_PLACE, "''", [f"'| ' || {SEV} || ' ' || severity || ' | ' || n || ' |'"]), ("one", "3", "''", "0", "0", "''", _q("", "## Files")), ("(SELECT DISTINCT path FROM i)", "4", "path", "0", "0", "''", ["''", "'### `' || path || '`'", "''"]),
        ("i", "4", "path", "1", "id", "''", [f"'- ' || {SEV} || ' [[' || id || ']] — t' || id || ' _( ' || type || ' )_'"]),
    ),
    "issues",
)
def report_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.issues(spark, sf_dir)
    files = i.withColumn("source_files", F.array(F.coalesce("source_file", F.lit("none")), F.concat(F.lit("all-"), (F.col("id") % 5).cast("string"))))
    index = registers.file_index(files).withColumn("title", F.concat(F.lit("t"), F.col("id").cast("string")))
    return render.numbered(render.file_issues(index, i.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))))


PEND = "status IN ('detected', 'verified', 'fixing')"


@query(
    f"""WITH c AS (SELECT 0 AS k, status AS v, count(*) AS n, count(*) FILTER ({PEND}) AS pending FROM issues GROUP BY 2 UNION ALL SELECT 1, severity, count(*), count(*) FILTER ({PEND}) FROM issues GROUP BY 2 UNION ALL SELECT 2, type, count(*), count(*) FILTER ({PEND}) FROM issues GROUP BY 2 UNION ALL SELECT 3, coalesce(confidence, 'unknown'), count(*), count(*) FILTER ({PEND}) FROM issues GROUP BY 2),
    l AS (SELECT id, severity, detected_at FROM issues WHERE {PEND} AND severity IN ('critical', 'high') UNION ALL SELECT * FROM (SELECT id, severity, detected_at FROM issues WHERE {PEND} AND severity = 'medium' ORDER BY detected_at DESC, id LIMIT 10)), o AS (SELECT *, row_number() OVER (ORDER BY detected_at DESC, id) AS r FROM l), one AS (SELECT count(*) AS n FROM issues), d AS (SELECT unnest(range(4)) AS k) """ + _lines(
        ("one", "0", "''", "0", "0", "''", ["'---'", "'total: ' || n", *_q("---", "", "# Issues")]), ("d", "1", "k", "0", "0", "''", ["''", "'## ' || ['status', 'severity', 'type', 'confidence'][k + 1]", *_q("", "| value | n | pending |", "|---|---|---|")]),
        ("c", "1", "k", "1", "CASE WHEN v IS NULL THEN 0 ELSE 1 END", "coalesce(v, '')", ["'| ' || coalesce(v, 'None') || ' | ' || n || ' | ' || pending || ' |'"]), ("one", "1", "0", "2", "0", "''", ["'| **total** | **' || n || '** | |'"]),
        ("one", "2", "''", "0", "0", "''", _q("", "## Pending", "")), ("o", "3", f"lpad(CAST({SEV_PLACE} AS VARCHAR), 2, '0')", "0", "r", "''", [f"'- ' || {SEV} || ' [[' || id || ']] ' || detected_at"]),
    ),
    "issues",
)
def report_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.issues(spark, sf_dir)
    return render.numbered(render.issue_dashboard(registers.dashboard(i.withColumn("is_pending", F.col("status").isin(*registers.PENDING))), registers.pending_list(i)))


@query(
    """WITH p AS (SELECT p_partkey, 'EXP-' || lpad(p_partkey::VARCHAR, 9, '0') AS id, CASE WHEN p_size % 10 = 0 THEN 'uncategorized' ELSE p_type END AS c, CASE p_size % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'stale' WHEN 2 THEN 'orphaned' WHEN 3 THEN 'deprecated' ELSE 'candidate' END AS st, p_name, p_size, p_brand FROM part), sh AS (SELECT * FROM p WHERE st <> 'candidate'),
    k AS (SELECT c, count(*) FILTER (st = 'active') AS a, count(*) FILTER (st = 'stale') AS s, count(*) FILTER (st IN ('orphaned', 'deprecated')) AS o FROM sh GROUP BY 1), one AS (SELECT count(*) FILTER (st <> 'candidate') AS total, count(*) FILTER (st = 'active') AS active, count(*) FILTER (st = 'stale') AS stale, count(*) FILTER (st IN ('orphaned', 'deprecated')) AS orphaned, count(*) FILTER (st = 'candidate') AS candidate, count(DISTINCT c) AS categories FROM p) """ + _lines(
        ("one", "0", "''", "0", "0", "''", ["'---'", "'total_patterns: ' || total", *[f"'{k}: ' || {k}" for k in ("active", "stale", "orphaned", "candidate", "categories")], *_q("---", "", "# Experience")]),
        ("one", "1", "''", "0", "0", "''", _q("", "## Categories", "", "| category | active | stale | orphaned |", "| --- | --- | --- | --- |")), ("k", "2", "c", "0", "0", "''", ["'| ' || c || ' | ' || a || ' | ' || s || ' | ' || o || ' |'"]), ("(SELECT DISTINCT c FROM sh)", "3", "c", "0", "0", "''", ["''", "'## ' || c", "''"]),
        ("sh", "3", "c", "1", "0", "id", ["""'- [' || id || '](volume-3-experience/' || c || '/' || id || '.md)' || CASE st WHEN 'stale' THEN ' ⚠️' WHEN 'orphaned' THEN ' 🗑️' WHEN 'deprecated' THEN ' ❌' ELSE '' END || ' — ' || CASE WHEN p_size % 3 = 0 THEN 'S' || p_size WHEN p_size % 3 = 1 THEN p_name ELSE id END || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' | ' || p_brand ELSE ' | ' || p_brand || ', a, b...' END"""]),
    )
)
def report_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, brand = F.col("p_size"), F.col("p_brand")
    status = F.when(n % 5 == 0, "active").when(n % 5 == 1, "stale").when(n % 5 == 2, "orphaned").when(n % 5 == 3, "deprecated").otherwise("candidate")
    some = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(brand)).otherwise(F.array(brand, F.lit("a"), F.lit("b"), F.lit("c")))
    p = views.table(spark, sf_dir, "part").select(
        F.concat(F.lit("EXP-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), F.when(n % 10 == 0, F.when(n % 20 == 0, "")).otherwise(F.col("p_type")).alias("category"), status.alias("status"),
        F.when(n % 3 == 1, F.col("p_name")).otherwise("").alias("title"), F.when(n % 3 == 0, F.concat(F.lit("S"), n.cast("string"))).alias("summary"), some.alias("clusters"),
    )
    return render.numbered(render.experience(p, registers.pattern_counts(p), True))


BOOKED = "'(volume-1-code/' || chapter || '/doc_' || k || '.md)'"


@query(
    f"""WITH {HEADED}, {FILES_OF}, {ISSUE_FILES}, nf AS (SELECT relpath, count(*) AS nf FROM pf GROUP BY 1), pg AS (SELECT md.*, nf FROM md JOIN nf USING (relpath)), ch AS (SELECT chapter, CASE WHEN min(k % 12) < 6 THEN 'Label ' || min(k % 12) ELSE chapter END AS label, count(DISTINCT relpath) AS np, count(DISTINCT path) AS nf, count(DISTINCT id) AS ni FROM pf JOIN md USING (relpath, chapter) LEFT JOIN isf USING (path) GROUP BY 1),
    one AS (SELECT (SELECT count(DISTINCT chapter) FROM md) AS c, (SELECT count(*) FROM md) AS p, (SELECT count(*) FROM hd) AS s) """ + _lines(
        ("one", "0", "''", "0", "0", "''", ["'---'", "'chapters: ' || c", "'pages: ' || p", "'symbols: ' || s", *_q("---", "", "# Book")]), ("one", "1", "''", "0", "0", "''", _q("", "## Contents")), ("ch", "2", "chapter", "0", "0", "''", ["''", "'### ' || label", "''"]),
        ("pg", "2", "chapter", "1", "0", "'doc_' || k || '.md'", [f"'- [Page ' || k || ']' || {BOOKED}"]), ("one", "3", "''", "0", "0", "''", _q("", "## Chapters")),
        ("ch", "4", "chapter", "0", "0", "''", ["''", "'### ' || label", "''", "'- **' || np || '** pages, **' || nf || '** files' || CASE WHEN ni > 0 THEN ', **' || ni || '** issues' ELSE '' END", *_q("", "| page | title | files |", "|---|---|---|")]),
        ("pg", "4", "chapter", "1", "0", "'doc_' || k || '.md'", [f"'| [doc_' || k || '.md]' || {BOOKED} || ' | Page ' || k || ' | ' || nf || ' |'"]),
    )
)
def report_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, md = _pages(spark, sf_dir), views.md(spark, sf_dir)
    k = F.col("k") % 12
    labels = md.filter(k < 6).select(F.concat(F.lit("ch-"), k.cast("string")).alias("chapter"), F.concat(F.lit("Label "), k.cast("string")).alias("label")).distinct()
    rows = pages.select("chapter", paths.basename(F.col("relpath")).alias("section"), "title", F.size(F.array_distinct("source_files")).alias("n_files"))
    return render.numbered(render.book(rows, labels, book.book_figures(pages, book.headed_symbols(md)), book.chapter_figures(pages, _issues(spark, sf_dir))))
