"""Named queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import code, paths
from weftline.operators import clusters, graph, registers, tasks
from weftline.plans import knowledge
from weftline.plans.base import oracle_sql, queries, query
from weftline.sources import projects, readers, views

__all__ = ["knowledge", "oracle_sql", "queries", "query"]

# ---- files ------------------------------------------------------------------------------------

BASE = "regexp_extract(path, '([^/]*)$', 1)"
DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
EXT = rf"regexp_extract({BASE}, '^.+(\.[^.]*)$', 1)"
DEGREE = "deg AS (SELECT dst AS doc_id, count(*) AS n_dep FROM edges GROUP BY dst)"
PRIORITY = rf"""CASE WHEN {EXT} IN ('.css','.scss','.less','.sass','.styl') THEN 'P4'
    WHEN regexp_matches(path, '{code.TEST}') OR regexp_matches(path, '{code.STORY}') THEN 'P3'
    WHEN regexp_matches({BASE}, '{code.ENTRY}') OR n_dep >= 10 THEN 'P0'
    WHEN regexp_matches(substr(content, 1, 8192), '{code.LOOSE_JSX}') OR regexp_matches(substr(content, 1, 8192), '{code.HOOK_CALL}') OR n_dep >= 5 THEN 'P1' ELSE 'P2' END"""
TOKENS = rf"""greatest(1, CAST(round(length(content) / (CASE WHEN {BASE} LIKE '%.d.ts' THEN 5.5::DOUBLE WHEN {EXT} IN ('.tsx','.jsx') AND regexp_matches(substr(content, 1, 8192), '{code.LOOSE_JSX}') THEN 3.8::DOUBLE WHEN {EXT} = '.css' THEN 5.0::DOUBLE ELSE 4.5::DOUBLE END)) AS BIGINT))"""
RANKED = f"{DEGREE}, ranked AS (SELECT f.doc_id, path, content, coalesce(n_dep, 0) AS n_dep, {PRIORITY.replace('n_dep', 'coalesce(n_dep, 0)')} AS priority, {TOKENS} AS tokens FROM files f LEFT JOIN deg USING (doc_id))"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, n_dep, priority, tokens, lines, jsx, hook: what the text tells is taken first, so that no join carries texts."""
    p, c = F.col("path"), F.col("content")
    jsx, hook = code.marks(c)
    f = views.files(spark, sf_dir).select("doc_id", "path", jsx.alias("jsx"), hook.alias("hook"), F.length(c).alias("chars"), code.line_count(c).alias("lines"))
    n = graph.dependents(views.edges(spark, sf_dir)).select(F.col("source").alias("doc_id"), F.col("n_dependents").alias("n_dep"))
    rows = f.join(n, "doc_id", "left").withColumn("n_dep", F.coalesce("n_dep", F.lit(0)))
    rows = rows.withColumn("priority", code.priority_of(p, F.col("n_dep"), F.col("jsx"), F.col("hook")))
    return rows.withColumn("tokens", code.estimated_tokens(p, F.col("chars"), F.col("jsx")))


@query(f"WITH {RANKED} SELECT path, priority, n_dep AS dependents, tokens, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines FROM ranked", "files", "edges")
def file_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("path", "priority", F.col("n_dep").alias("dependents"), "tokens", "lines")


@query(
    rf"""WITH {RANKED}, said AS (SELECT path, priority, concat_ws(' + ',
    CASE WHEN regexp_matches({BASE}, '{code.ENTRY}') THEN 'entry file (naming pattern)' END, CASE WHEN regexp_matches(path, '{code.TEST}') THEN 'test file' END,
    CASE WHEN regexp_matches(path, '{code.STORY}') THEN 'story file' END, CASE WHEN {EXT} = '.css' THEN 'pure style file' END,
    CASE WHEN n_dep >= 10 THEN 'highly depended (' || n_dep || ')' WHEN n_dep >= 5 THEN 'depended (' || n_dep || ')' END,
    CASE WHEN priority = 'P1' AND regexp_matches(substr(content, 1, 8192), '{code.LOOSE_JSX}') THEN 'contains JSX' END,
    CASE WHEN priority = 'P1' AND regexp_matches(substr(content, 1, 8192), '{code.HOOK_CALL}') THEN 'contains hooks' END) AS r FROM ranked)
    SELECT path, CASE WHEN r = '' THEN 'default (' || priority || ')' ELSE r END AS reason FROM said""",
    "files", "edges",
)
def priority_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    return r.select("path", code.reason_of(F.col("path"), F.col("priority"), F.col("n_dep"), F.col("jsx"), F.col("hook")).alias("reason"))


@query(f"WITH {RANKED} SELECT {DIR} AS folder, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_files, min(priority) AS priority FROM ranked GROUP BY 1", "files", "edges")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).groupBy(paths.dirname(F.col("path")).alias("folder"))
    return rows.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_files"), F.min("priority").alias("priority"))


@query(f"WITH {RANKED} SELECT {DIR} AS folder, path, row_number() OVER (PARTITION BY {DIR} ORDER BY priority, n_dep DESC, path, doc_id) - 1 AS place FROM ranked", "files", "edges")
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder in their order, without bringing a folder into one task."""
    rows = _ranked(spark, sf_dir).select(paths.dirname(F.col("path")).alias("folder"), "path", "priority", (-F.col("n_dep")).alias("d"), "doc_id")
    return tasks.ranked(rows, ["folder"], ["priority", "d", "path", "doc_id"], "place").select("folder", "path", "place")


@query(f"WITH {RANKED} SELECT priority, count(*) AS n FROM ranked GROUP BY 1", "files", "edges")
def priority_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {EXT} AS ext, count(*) AS n FROM files GROUP BY 1", "files")
def count_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.by_extension(views.files(spark, sf_dir))


@query(f"SELECT path FROM files WHERE {EXT} IN ('.ts','.tsx','.js','.jsx','.vue','.svelte','.mjs','.cjs','.mts')", "files")
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.source_files(views.files(spark, sf_dir)).select("path")


@query(f"SELECT path, 'styling module' AS reason FROM files WHERE (contains(lower({BASE}), '.styled.') OR contains(lower({BASE}), '.styles.')) AND NOT contains(lower({BASE}), '.spec.') AND NOT contains(lower({BASE}), '.test.')", "files")
def style_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.style_split(views.files(spark, sf_dir))[1].select("path", "reason")


@query("SELECT path, sha256(content) AS sha256 FROM files", "files")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.hashes(views.files(spark, sf_dir))


@query(
    f"""WITH {RANKED}, x AS (SELECT path, priority, tokens, lower({BASE}) AS b, lower({DIR}) AS d FROM ranked) SELECT path, CASE WHEN b LIKE 'app%' OR b LIKE 'main%' OR b LIKE 'index%' THEN 'entry'
    WHEN b LIKE 'use%' OR contains(d, 'hook') THEN 'hooks' WHEN contains(d, 'type') OR contains(b, '.d.ts') OR contains(b, 'interface') OR contains(b, 'enum') THEN 'types'
    WHEN contains(d, 'components') OR contains(d, 'ui') OR contains(d, 'common') THEN 'ui-components' WHEN contains(d, 'pages') OR contains(d, 'features') OR contains(d, 'modules') THEN 'business-components'
    WHEN contains(d, 'util') OR contains(d, 'helpers') OR contains(d, 'lib') THEN 'utils' WHEN priority = 'P0' THEN 'entry' WHEN priority = 'P1' THEN 'business-components' ELSE 'utils' END AS role FROM x""",
    "files", "edges",
)
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("path", code.role(F.col("path"), F.col("priority")).alias("role"))


HEAD = "substr(content, 1, 8192)"
#: Texts with code in front, so that every pattern has something to find.
CODE = """code AS (SELECT path, CASE doc_id % 6 WHEN 0 THEN 'export const Box' || (doc_id % 9) || ' = () => <Panel />' WHEN 1 THEN 'export type T = 1' || chr(10) || 'function helper() {}' || chr(10) || 'useData(1); useData(2); useMore (3)'
    WHEN 2 THEN 'interface CardProps {}' || chr(10) || 'export { a, b }' || chr(10) || 'async function Run() {} </Card>' WHEN 3 THEN 'export * from "./a"' || chr(10) || '// x' ELSE '' END || CASE WHEN doc_id % 6 = 3 THEN '' ELSE chr(10) || content END AS content, doc_id FROM files)"""
NAMES_FOUND = r"""list_distinct(list_filter(flatten([regexp_extract_all(h, 'export\s+(?:const|function|let|var|class)\s+(\w+)', 1), regexp_extract_all(h, 'export\s+default\s+(?:function|class)\s+(\w+)', 1), regexp_extract_all(h, 'export\s*\{\s*(\w+)', 1),
    regexp_extract_all(h, 'export\s+default\s+(\w+)', 1), regexp_extract_all(h, 'export\s+(?:interface|type)\s+(\w+)', 1), regexp_extract_all(h, 'export\s+enum\s+(\w+)', 1)]), lambda x: x <> ''))"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("export const Box"), (F.col("doc_id") % 9).cast("string"), F.lit(" = () => <Panel />"))).when(k == 1, "export type T = 1\nfunction helper() {}\nuseData(1); useData(2); useMore (3)")
        .when(k == 2, "interface CardProps {}\nexport { a, b }\nasync function Run() {} </Card>").when(k == 3, 'export * from "./a"\n// x').otherwise("")
    )
    return views.files(spark, sf_dir).select("path", F.concat(text, F.when(k == 3, "").otherwise(F.concat(F.lit("\n"), "content"))).alias("content"))


@query(
    rf"""WITH {CODE}, h AS (SELECT path, content, {HEAD} AS h, doc_id FROM code WHERE {EXT} <> '.css' AND NOT regexp_matches(path, '\.(test|spec|stories|story)\.(ts|tsx|js|jsx)$|/__tests__/')), x AS (SELECT *, regexp_matches(h, '{code.STRICT_JSX}') AS j, {NAMES_FOUND} AS e FROM h)
    SELECT path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines, greatest(1, CAST(round(length(content) / (CASE WHEN {BASE} LIKE '%.d.ts' THEN 5.5::DOUBLE WHEN {EXT} IN ('.tsx','.jsx') AND j THEN 3.8::DOUBLE ELSE 4.5::DOUBLE END)) AS BIGINT)) AS tokens, j AS has_jsx, doc_id % 6 = 3 AS is_barrel,
    j OR len(list_filter(e, lambda n: regexp_matches(n, '^[A-Z]'))) > 0 AS is_component, CASE doc_id % 6 WHEN 0 THEN 'Box' || (doc_id % 9) WHEN 1 THEN 'T' WHEN 2 THEN 'Run' END AS component, array_to_string(e, ',') AS exports,
    CASE doc_id % 6 WHEN 1 THEN 'useData,useMore' ELSE '' END AS hooks, CASE doc_id % 6 WHEN 2 THEN 'CardProps' ELSE '' END AS prop_types, CASE doc_id % 6 WHEN 1 THEN 'helper' WHEN 2 THEN 'Run' ELSE '' END AS functions FROM x""",
    "files",
)
def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code.file_meta(_coded(spark, sf_dir))
    for c in ("exports", "hooks", "prop_types", "functions"):
        rows = rows.withColumn(c, F.array_join(c, ","))
    return rows


@query(f"SELECT path, contains('/' || lower({DIR}) || '/', '/pages/') AS business, lower({BASE}) IN ('index.ts', 'index.tsx', 'index.jsx', 'index.css') AS entry_stem FROM files", "files")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return views.files(spark, sf_dir).select("path", code.is_business(p).alias("business"), code.is_entry_stem(p).alias("entry_stem"))


@query(rf"SELECT path, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(path, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')), ''), 'root') AS id FROM files", "files")
def path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("path", paths.path_id(F.col("path")).alias("id"))


@query(f"""WITH s AS (SELECT path FROM files WHERE {EXT} IN ('.ts','.tsx','.js','.jsx','.vue','.svelte','.mjs','.cjs','.mts')) SELECT (SELECT count(DISTINCT path) FROM s) AS n_files, count(DISTINCT a) AS n_folders FROM (SELECT unnest(list_transform(range(1, len(string_split(path,'/'))), lambda k: array_to_string(list_slice(string_split(path,'/'), 1, k), '/'))) AS a FROM s)""", "files")
def project_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.project_figures(views.files(spark, sf_dir))


@query(
    f"""WITH {RANKED}, t AS (SELECT sum(tokens) AS t FROM ranked) SELECT CAST(least(300000, greatest(20000, round(t * 0.05::DOUBLE))) AS BIGINT) AS split, CAST(least(150000, greatest(10000, round(t * 0.025::DOUBLE))) AS BIGINT) AS no_split, CAST(least(15000, greatest(3000, round(t * 0.003::DOUBLE))) AS BIGINT) AS merge_min,
    CAST(least(300000, greatest(1000, round(t * 0.25::DOUBLE))) AS BIGINT) AS max_tokens, CAST(least(15000, greatest(50, round(t * 0.05::DOUBLE))) AS BIGINT) AS min_tokens FROM t""",
    "files", "edges",
)
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _ranked(spark, sf_dir).agg(F.sum("tokens").alias("t"))
    return t.select(*[c.alias(k) for k, c in (code.split_thresholds(F.col("t")) | code.cluster_thresholds(F.col("t"))).items()])


# ---- change sets ------------------------------------------------------------------------------


@query("""SELECT doc_id AS path, CASE WHEN b.text IS NULL THEN 'added' WHEN a.text IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM documents b FULL JOIN after a USING (doc_id) WHERE b.text IS DISTINCT FROM a.text""", "after")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda d: readers.hashes(d.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    return readers.snapshot_changes(h(views.table(spark, sf_dir, "documents")), h(views.after(spark, sf_dir)))


CLOSURE = "WITH RECURSIVE r(node) AS (SELECT doc_id FROM documents WHERE doc_id % 97 = 5 UNION SELECT e.src FROM edges e JOIN r ON e.dst = r.node)"


@query(f"{CLOSURE} SELECT node FROM r", "edges")
def affected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = views.table(spark, sf_dir, "documents").filter("doc_id % 97 = 5").select(F.col("doc_id").alias("node"))
    return graph.affected(seeds, views.edges(spark, sf_dir)).select("node")


@query(f"{CLOSURE} SELECT node AS path, CASE WHEN node % 97 = 5 THEN 'Directly modified' ELSE 'Depends on changed file' END AS reason FROM r", "edges")
def affected_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = views.table(spark, sf_dir, "documents").filter("doc_id % 97 = 5").select(F.col("doc_id").alias("path"), F.lit("modified").alias("status"))
    return graph.affected_with_reason(changes, views.edges(spark, sf_dir)).select("path", "reason")


DEPTHS = """WITH RECURSIVE r(node, depth) AS (SELECT doc_id, 0 FROM documents WHERE doc_id % 97 = 5 UNION SELECT e.src, depth + 1 FROM edges e JOIN r ON e.dst = r.node WHERE depth < 40), d AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1)"""


@query(f"{DEPTHS} SELECT {DIR} AS folder, count(*) AS n_files, arg_min(CASE WHEN depth = 0 THEN 'Directly modified' ELSE 'Depends on changed file' END, depth) AS reason FROM d JOIN files f ON f.doc_id = d.node GROUP BY 1", "edges", "files")
def affected_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = views.table(spark, sf_dir, "documents").filter("doc_id % 97 = 5").select(F.col("doc_id").alias("path"), F.lit("modified").alias("status"))
    got = graph.affected_with_reason(changes, views.edges(spark, sf_dir)).withColumnRenamed("path", "doc_id")
    named = views.files(spark, sf_dir).select("doc_id", "path").join(got, "doc_id")
    return graph.affected_folders(named, paths.dirname(F.col("path")))


@query(
    f"""{CLOSURE}, a AS (SELECT DISTINCT {DIR} AS folder FROM files), h AS (SELECT DISTINCT {DIR} AS folder FROM r JOIN files f ON f.doc_id = r.node)
    SELECT (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM h) AS affected, (SELECT count(*) FROM a WHERE folder NOT IN (SELECT folder FROM h)) AS unaffected, CAST(round((1 - (SELECT count(*) FROM h)::DOUBLE / (SELECT count(*) FROM a)) * 100) AS BIGINT) AS reduction""",
    "edges", "files",
)
def analysis_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).select("doc_id", paths.dirname(F.col("path")).alias("folder"))
    return graph.analysis_scope(f, f.join(affected_nodes(spark, sf_dir), F.col("doc_id") == F.col("node"), "left_semi"))


@query(f"{CLOSURE} SELECT id, CASE WHEN status <> 'in_progress' AND (folder IN (SELECT node FROM r) OR folder + 7 IN (SELECT node FROM r)) THEN 'pending' ELSE status END AS status FROM tasks t", "edges", "tasks")
def reset_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task has two files, of the numbers of its folder and of the seventh behind it."""
    t = views.tasks(spark, sf_dir)
    of = t.select(F.col("id").alias("task"), F.explode(F.array(F.col("folder"), F.col("folder") + 7)).alias("path"))
    return tasks.reset_by_file(t, of, affected_nodes(spark, sf_dir).withColumnRenamed("node", "path")).select("id", "status")


# ---- graphs -----------------------------------------------------------------------------------


@query("SELECT dst AS source, count(*) AS n_dependents FROM edges GROUP BY 1", "edges")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependents(views.edges(spark, sf_dir))


@query("SELECT dst AS source, count(*) AS n_dependents FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "edges")
def most_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(graph.dependents(views.edges(spark, sf_dir)), "n_dependents")


@query("SELECT doc_id AS source, count(src) AS n_dependencies FROM documents LEFT JOIN edges ON src = doc_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "edges")
def most_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"))
    return graph.top(graph.out_degree(views.edges(spark, sf_dir), modules), "n_dependencies")


@query("SELECT x.src AS a, x.dst AS b FROM circles x JOIN circles y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst", "circles")
def mutual_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mutual(views.circles(spark, sf_dir))


REACH = "WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM circles UNION SELECT r.a, e.dst FROM r JOIN circles e ON e.src = r.b)"


@query(f"{REACH} SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1", "circles")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(views.circles(spark, sf_dir))


@query(
    f"""{REACH}, m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1), i AS (SELECT a.cycle AS c, src, dst FROM circles JOIN m a ON a.node = src JOIN m b ON b.node = dst AND a.cycle = b.cycle),
    d(c, node, k) AS (SELECT DISTINCT cycle, cycle, 0 FROM m UNION SELECT d.c, i.dst, k + 1 FROM d JOIN i ON i.c = d.c AND i.src = d.node WHERE k < 40), dist AS (SELECT c, node, min(k) AS k FROM d GROUP BY 1, 2), up AS (SELECT i.c, i.dst AS node, min(i.src) AS parent FROM i JOIN dist x ON x.c = i.c AND x.node = i.src JOIN dist y ON y.c = i.c AND y.node = i.dst AND y.k = x.k + 1 GROUP BY 1, 2),
    e AS (SELECT i.c, min({{'k': k + 1, 'u': src}}) AS x FROM i JOIN dist ON dist.c = i.c AND dist.node = i.src WHERE i.dst = i.c GROUP BY 1), p(c, node, place) AS (SELECT c, x.u, x.k - 1 FROM e UNION ALL SELECT p.c, up.parent, place - 1 FROM p JOIN up ON up.c = p.c AND up.node = p.node WHERE place > 0)
    SELECT c AS cycle, CAST(place AS INT) AS place, node FROM p UNION ALL SELECT c, CAST(x.k AS INT), c FROM e""",
    "circles",
)
def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_paths(views.circles(spark, sf_dir))


@query("WITH RECURSIVE r(node) AS (SELECT doc_id FROM documents WHERE doc_id % 97 = 5 UNION SELECT e.src FROM circles e JOIN r ON e.dst = r.node) SELECT node FROM r", "circles")
def affected_in_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = views.table(spark, sf_dir, "documents").filter("doc_id % 97 = 5").select(F.col("doc_id").alias("node"))
    return graph.affected(seeds, views.circles(spark, sf_dir)).select("node")


@query(
    """WITH seeds AS (SELECT doc_id AS seed FROM documents WHERE doc_id % 29 = 3), one AS (SELECT seed, dst AS node FROM seeds JOIN edges ON src = seed WHERE dst % 31 <> 0),
    two AS (SELECT seed, dst AS node FROM one JOIN edges ON src = node WHERE dst % 31 <> 0), r AS (SELECT DISTINCT seed, node FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE seed <> node)
    SELECT node, count(DISTINCT seed) AS n_seeds FROM r GROUP BY 1 HAVING count(DISTINCT seed) >= 3""",
    "edges",
)
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    return graph.hubs(graph.reach_two(d.filter("node % 29 = 3"), views.edges(spark, sf_dir), d.filter("node % 31 = 0")))


@query(
    """WITH n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges)), i AS (SELECT node FROM n WHERE node % 10 = 3)
    SELECT 'internal' AS kind, node FROM i UNION SELECT 'external_dependency', dst FROM edges WHERE src % 10 = 3 AND dst % 10 <> 3 UNION SELECT 'external_dependent', src FROM edges WHERE dst % 10 = 3 AND src % 10 <> 3""",
    "edges",
)
def folder_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(views.edges(spark, sf_dir), F.col("node") % 10 == 3)


@query(
    """WITH RECURSIVE e AS (SELECT o_custkey AS a, o_custkey % 17 AS b FROM orders UNION SELECT o_custkey % 17, o_custkey FROM orders), r(node, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1"""
)
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 17).alias("dst")).distinct()
    return graph.components(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), e)


#: Files as seeds and barrels, and the hubs among them.
SEEDS = f"""{RANKED}, f AS (SELECT doc_id AS p, CAST(30 * tokens AS BIGINT) AS t, doc_id % 11 = 4 AS seed, doc_id % 53 = 0 AS barrel FROM ranked), clear AS (SELECT src, dst FROM edges WHERE dst NOT IN (SELECT p FROM f WHERE barrel)),
    r1 AS (SELECT p AS seed, dst AS node FROM f JOIN clear ON src = p WHERE seed), reached AS (SELECT * FROM r1 UNION SELECT r1.seed, dst FROM r1 JOIN clear ON src = node), hub AS (SELECT node FROM reached WHERE seed <> node GROUP BY 1 HAVING count(*) >= 3)"""
#: Seeds settled one after the other: k, the paths taken so far, the seed and what it gets.
SEED_FOLD = f"""{SEEDS}, shut AS (SELECT node FROM hub UNION SELECT p FROM f WHERE barrel), open AS (SELECT src, dst FROM edges WHERE dst NOT IN (SELECT node FROM shut)), th AS (SELECT CAST(least(15000, greatest(50, round(sum(t) * 0.05::DOUBLE))) AS BIGINT) AS least, map(list(p ORDER BY p), list(t ORDER BY p)) AS m FROM f),
    w1 AS (SELECT src AS seed, list(dst) AS one FROM open GROUP BY 1), w2 AS (SELECT a.src AS seed, list({{'path': b.dst, 'via': b.src}}) AS two FROM open a JOIN open b ON a.dst = b.src GROUP BY 1), w3 AS (SELECT dst AS seed, list(src) AS uses FROM edges WHERE src NOT IN (SELECT node FROM shut) GROUP BY 1),
    z AS (SELECT row_number() OVER (ORDER BY t DESC, p) AS k, p AS seed, coalesce(one, []) AS one, coalesce(two, []) AS two, coalesce(uses, []) AS uses FROM f LEFT JOIN w1 ON w1.seed = p LEFT JOIN w2 ON w2.seed = p LEFT JOIN w3 ON w3.seed = p WHERE f.seed),
    s(k, taken, seed, own) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT k, list_concat(taken, kept), seed, kept FROM (SELECT k, taken, seed, CASE WHEN NOT list_contains(taken, seed) AND (k = 1 OR list_sum(list_transform(o, lambda x: m[x])) >= least) THEN o ELSE [] END AS kept FROM th,
        (SELECT k, taken, seed, list_distinct(list_concat(list_concat([seed], n1), list_concat(list_transform(list_filter(two, lambda x: NOT list_contains(taken, x.path) AND list_contains(list_concat([seed], n1), x.via)), lambda x: x.path), list_filter(uses, lambda x: NOT list_contains(taken, x))))) AS o FROM (SELECT z.k, taken, z.seed, two, uses, list_filter(one, lambda x: NOT list_contains(taken, x)) AS n1 FROM s JOIN z ON z.k = s.k + 1))))"""


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    return r.select(F.col("doc_id").alias("path"), (30 * F.col("tokens")).alias("tokens"), (F.col("doc_id") % 11 == 4).alias("is_seed"), (F.col("doc_id") % 53 == 0).alias("is_barrel"))


@query(f"WITH RECURSIVE {SEED_FOLD} SELECT seed AS cluster, unnest(own) AS path, m[unnest(own)] AS tokens FROM s, th", "files", "edges")
def seed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.greedy(_seeded(spark, sf_dir), views.edges(spark, sf_dir))


@query(f"WITH {SEEDS} SELECT 'shared-utilities' AS cluster, p AS path, t AS tokens FROM f JOIN hub ON node = p WHERE NOT barrel", "files", "edges")
def shared_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs that many seeds reach, as one cluster."""
    return clusters.shared(_seeded(spark, sf_dir), views.edges(spark, sf_dir))


@query(
    """WITH cf AS (SELECT DISTINCT l_suppkey AS cluster, l_partkey AS path FROM lineitem), s AS (SELECT cluster, count(*) AS n FROM cf GROUP BY 1), p AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS shared FROM cf x JOIN cf y ON x.path = y.path AND x.cluster < y.cluster GROUP BY 1, 2)
    SELECT a, b, shared, shared::DOUBLE / least(sa.n, sb.n) AS ratio FROM p JOIN s sa ON sa.cluster = a JOIN s sb ON sb.cluster = b WHERE shared::DOUBLE / least(sa.n, sb.n) >= 0.3"""
)
def cluster_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cf = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_partkey").alias("path"))
    return clusters.overlaps(cf)


# ---- packing and tasks ------------------------------------------------------------------------


@query(
    """WITH RECURSIVE x AS (SELECT l_orderkey, l_quantity AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem),
    r(l_orderkey, k, chunk, n, total) AS (SELECT l_orderkey, k, CAST(0 AS BIGINT), CAST(1 AS BIGINT), w FROM x WHERE k = 1 UNION ALL SELECT x.l_orderkey, x.k, CASE WHEN total + w > 60 THEN chunk + 1 ELSE chunk END, CASE WHEN total + w > 60 THEN 1 ELSE n + 1 END, CASE WHEN total + w > 60 THEN w ELSE total + w END FROM r JOIN x ON x.l_orderkey = r.l_orderkey AND x.k = r.k + 1)
    SELECT l_orderkey, chunk, max(n) AS n, max(total) AS total FROM r GROUP BY 1, 2"""
)
def next_fit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem")
    return tasks.next_fit(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "l_quantity", 60)


BUDGET = "CAST(least(300000, greatest(15000, round(CASE WHEN tokens <= 10000 THEN tokens * 2.5::DOUBLE + 8000 WHEN tokens <= 50000 THEN tokens * 2.0::DOUBLE + 10000 ELSE tokens * 1.5::DOUBLE + 15000 END))) AS BIGINT)"


CAPPED = BUDGET.replace("greatest(15000, round(", "greatest(15000, least(round(").replace("END))) AS", "END), CASE WHEN project > 0 THEN round(project * 0.3::DOUBLE) ELSE 1e9 END))) AS")


@query(f"WITH p AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY folder) * (folder % 3) AS BIGINT) AS project FROM tasks) SELECT id, {BUDGET} AS budget, {CAPPED} AS capped FROM p", "tasks")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets alone, and under the cap of a project's tokens: none for every third folder."""
    t = views.tasks(spark, sf_dir)
    whole = t.groupBy("folder").agg((F.sum("tokens") * (F.first("folder") % 3)).alias("project"))
    return t.join(whole, "folder").select("id", code.token_budget(F.col("tokens")).alias("budget"), code.token_budget(F.col("tokens"), F.col("project")).alias("capped"))


PHASES_OF = """e AS (SELECT user_id AS run, event_id AS ord, ['INIT', 'SCAN', 'DEPENDENCY', 'GEN', 'ASSEMBLE', 'VALIDATE'][event_id % 6 + 1] AS phase, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'completed' END AS status, CASE event_id % 7 WHEN 0 THEN 'FEEDBACK' WHEN 1 THEN NULL ELSE ['INIT', 'SCAN', 'DEPENDENCY', 'GEN', 'ASSEMBLE', 'VALIDATE'][event_id % 4 + 1] END AS next FROM events)"""


def _phase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, names = F.col("event_id"), F.array(*map(F.lit, tasks.PHASES))
    pick = lambda n: F.element_at(names, (k % n + 1).cast("int"))
    status = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "skipped").otherwise("completed")
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), k.alias("ord"), pick(6).alias("phase"), status.alias("status"), F.when(k % 7 == 0, "FEEDBACK").when(k % 7 != 1, pick(4)).alias("next"), k.alias("at"))


@query(
    f"""WITH {PHASES_OF}, r AS (SELECT *, CAST(sum(CASE WHEN next = 'FEEDBACK' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS retries, max(CASE WHEN next IS NOT NULL THEN {{'o': ord, 'n': next}} END) OVER w AS n, max(CASE WHEN status = 'completed' THEN {{'o': ord, 'p': phase}} END) OVER w AS s FROM e WINDOW w AS (PARTITION BY run ORDER BY ord))
    SELECT run, ord, phase, status, next, retries, CASE WHEN retries > 3 THEN 'DONE' ELSE n.n END AS current, s.p AS last_success FROM r"""
)
def phase_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.transitions(_phase_events(spark, sf_dir)).drop("at")


@query(
    f"""WITH {PHASES_OF}, a AS (SELECT run, ord, phase, status, 0 AS k FROM e UNION ALL SELECT run, ord, next, 'in_progress', 1 FROM e WHERE next IS NOT NULL) SELECT run, phase, arg_max(status, ord * 2 + k) AS status, arg_min(ord, ord * 2 + k) AS started, max(CASE WHEN k = 0 THEN ord END) AS ended FROM a GROUP BY 1, 2"""
)
def phase_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.phase_records(_phase_events(spark, sf_dir))


@query("SELECT path, row_number() OVER (ORDER BY path) - 1 AS place FROM files", "files")
def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.ranked(views.files(spark, sf_dir).select("path"), [], ["path"], "place")


@query("SELECT id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, detected_at DESC, id) - 1 AS place FROM issues", "issues")
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.ranked(views.issues(spark, sf_dir).select("id", "severity", "detected_at"), [], registers.latest_order(), "place").select("id", "place")


@query(
    """WITH a AS (SELECT id, status, CASE status WHEN 'completed' THEN 'skip' WHEN 'pending' THEN 'run' ELSE 'retry' END AS action FROM tasks) SELECT id, row_number() OVER (ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'in_progress' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END, id) - 1 AS by_status,
    row_number() OVER (ORDER BY CASE action WHEN 'retry' THEN 0 WHEN 'run' THEN 1 ELSE 2 END, id) - 1 AS by_action FROM a""",
    "tasks",
)
def task_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of tasks by state (failed first) and by what is to be done (retries first)."""
    t = views.tasks(spark, sf_dir).select("id", "status").withColumn("action", tasks.action(F.col("status"), F.lit(False), True))
    one = tasks.ranked(t, [], [tasks.status_order(F.col("status")), F.col("id")], "by_status")
    return tasks.ranked(one, [], [tasks.action_order(F.col("action")), F.col("id")], "by_action").select("id", "by_status", "by_action")


@query(
    f"""WITH a AS (SELECT id, tokens, CASE status WHEN 'completed' THEN 'skip' WHEN 'pending' THEN 'run' ELSE 'retry' END AS action FROM tasks)
    SELECT id, action, {BUDGET} AS budget, CASE WHEN action <> 'skip' THEN 1 + 10 * (row_number() OVER (PARTITION BY action <> 'skip' ORDER BY id) - 1) END AS issue_from FROM a""",
    "tasks",
)
def task_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tasks(spark, sf_dir)
    return tasks.schedule(t.select("id", "tokens", F.col("id").alias("ord")), t.select("id", "status", F.lit(0).alias("ord"))).select("id", "action", "budget", "issue_from")


@query("""WITH f AS (SELECT id, tokens FROM tasks WHERE status = 'pending' ORDER BY id LIMIT 50) SELECT id, tokens, running FROM (SELECT id, tokens, CAST(sum(tokens) OVER (ORDER BY id) AS BIGINT) AS running FROM f) WHERE running <= 3000000""", "tasks")
def task_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.batch(views.tasks(spark, sf_dir).filter("status = 'pending'").select("id", "tokens"), 50, 3_000_000, ["id"])


@query(
    """SELECT folder, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed,
    CAST(round(100 * count(*) FILTER (status = 'completed')::DOUBLE / count(*)) AS BIGINT) AS percent, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'in_progress') > 0 THEN 'in_progress' WHEN count(*) FILTER (status = 'pending') > 0 THEN 'pending' ELSE 'completed' END AS status FROM tasks GROUP BY folder""",
    "tasks",
)
def folder_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.status_counts(views.tasks(spark, sf_dir), ["folder"])


@query("""SELECT id, CASE WHEN status = 'completed' AND id % 5 = 0 THEN CASE WHEN folder % 5 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN status = 'completed' AND id % 5 = 0 AND folder % 5 < 3 THEN folder % 5 + 1 ELSE folder % 5 END AS retry_count FROM tasks""", "tasks")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tasks(spark, sf_dir).withColumn("retry_count", F.col("folder") % 5)
    return tasks.retried(t, t.filter("id % 5 = 0")).select("id", "status", "retry_count")


@query("SELECT id, status FROM tasks WHERE id % 3 <> 0 UNION ALL SELECT id, 'pending' FROM tasks WHERE id % 3 = 0", "tasks")
def task_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tasks(spark, sf_dir)
    return tasks.upsert_new(t.filter("id % 3 <> 0"), t)


@query("SELECT l_partkey AS path, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS tasks FROM lineitem GROUP BY 1")
def file_task_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cf = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").cast("string").alias("task"))
    return tasks.file_task_index(cf)[0].select("path", F.array_join("tasks", ",").alias("tasks"))


@query(
    """WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(floor(k / greatest(5, ceil(n / 3.0))) AS BIGINT) AS chunk FROM x"""
)
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]
    return tasks.chunked(views.table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "chunk")


# ---- registers --------------------------------------------------------------------------------


@query(
    """WITH i AS (SELECT id, detected_at, type || '::' || array_to_string(list_sort([coalesce(source_file, ''), 'g' || (id % 3)]), ',') AS k FROM issues WHERE type <> ''), w AS (SELECT *, first_value(id) OVER (PARTITION BY k ORDER BY detected_at, id) AS final_keeper, min(detected_at || '/' || lpad(id::VARCHAR, 12, '0')) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
    x AS (SELECT *, p IS NULL OR detected_at || '/' || lpad(id::VARCHAR, 12, '0') < p AS record FROM w), y AS (SELECT *, min(CASE WHEN record THEN id END) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM x)
    SELECT id, id <> final_keeper AS is_duplicate, CASE WHEN id <> final_keeper THEN CASE WHEN record THEN after ELSE CAST(split_part(p, '/', 2) AS BIGINT) END END AS duplicate_of, final_keeper FROM y""",
    "issues",
)
def issue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of two files each, named in either order."""
    one, two = F.coalesce("source_file", F.lit("")), F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))
    i = views.issues(spark, sf_dir).withColumn("source_files", F.when(F.col("id") % 2 == 0, F.array(one, two)).otherwise(F.array(two, one)))
    return registers.dedup(i, ["type", "source_files"]).select("id", "is_duplicate", "duplicate_of", "final_keeper")


@query(
    """SELECT 'status' AS dimension, status AS value, count(*) AS n, count(*) FILTER (status IN ('detected', 'verified', 'fixing')) AS pending FROM issues GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (status IN ('detected', 'verified', 'fixing')) FROM issues GROUP BY 2
    UNION ALL SELECT 'type', type, count(*), count(*) FILTER (status IN ('detected', 'verified', 'fixing')) FROM issues GROUP BY 2 UNION ALL SELECT 'confidence', coalesce(confidence, 'unknown'), count(*), count(*) FILTER (status IN ('detected', 'verified', 'fixing')) FROM issues GROUP BY 2""",
    "issues",
)
def issue_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.dashboard(views.issues(spark, sf_dir).withColumn("is_pending", F.col("status").isin(*registers.PENDING)))


@query(
    """SELECT id, severity, detected_at FROM issues WHERE status IN ('detected', 'verified', 'fixing') AND severity IN ('critical','high') UNION ALL SELECT * FROM (SELECT id, severity, detected_at FROM issues WHERE status IN ('detected', 'verified', 'fixing') AND severity = 'medium' ORDER BY detected_at DESC, id LIMIT 10)""", "issues"
)
def pending_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.pending_list(views.issues(spark, sf_dir)).select("id", "severity", "detected_at")


@query("""SELECT source_file, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, min(id) AS first_id, max(id) AS last_id FROM issues GROUP BY 1""", "issues")
def file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.by_file(views.issues(spark, sf_dir))


@query("SELECT f AS path, id, type, severity, status FROM (SELECT id, type, severity, status, unnest([source_file, 'all-' || (id % 5)]) AS f FROM issues WHERE type IS NOT NULL)", "issues")
def file_issue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.issues(spark, sf_dir).withColumn("source_files", F.array("source_file", F.concat(F.lit("all-"), (F.col("id") % 5).cast("string"))))
    return registers.file_index(i)


@query("""SELECT type, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM issues GROUP BY 1""", "issues")
def issue_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.cross_tab(views.issues(spark, sf_dir))


ALLOWED = "('bug','security','typescript','performance','dead_code','complexity','maintainability','ux')"
BROKEN = f"""v AS (SELECT id, 'missing_type' AS violation, type AS value, 'error' AS level FROM issues WHERE coalesce(type, '') = '' UNION ALL SELECT id, 'invalid_type', type, 'error' FROM issues WHERE type <> '' AND type NOT IN {ALLOWED}
    UNION ALL SELECT id, 'wrong_chapter', chapter, 'warning' FROM issues WHERE type IN {ALLOWED} AND chapter <> 'unknown' AND chapter <> CASE type WHEN 'bug' THEN 'ch-01-bugs' WHEN 'security' THEN 'ch-02-security' WHEN 'typescript' THEN 'ch-03-typescript' WHEN 'performance' THEN 'ch-04-performance' WHEN 'dead_code' THEN 'ch-05-dead-code' WHEN 'complexity' THEN 'ch-06-complexity' WHEN 'maintainability' THEN 'ch-07-maintainability' ELSE 'ch-08-ux' END
    UNION ALL SELECT id, 'invalid_severity', severity, 'warning' FROM issues WHERE severity <> '' AND severity NOT IN ('critical','high','medium','low') UNION ALL SELECT id, 'invalid_confidence', confidence, 'warning' FROM issues WHERE confidence <> '' AND confidence NOT IN ('high','medium','low')
    UNION ALL SELECT id, 'invalid_status', status, 'warning' FROM issues WHERE status <> '' AND status NOT IN ('detected','acknowledged','verified','fixing','fixed','verified_fixed','archived','false_positive','stale','disputed','closed'))"""


@query(f"WITH {BROKEN} SELECT * FROM v", "issues")
def issue_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.violations(views.issues(spark, sf_dir))


@query(f"WITH {BROKEN} SELECT (SELECT count(*) FROM issues) AS total, count(*) AS violations, count(DISTINCT id) AS failed, (SELECT count(*) FROM issues) - count(DISTINCT id) AS passed FROM v", "issues")
def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.issues(spark, sf_dir)
    return registers.validator_summary(i, registers.violations(i))


@query(
    """WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'bugs' WHEN 1 THEN 'type-safety' WHEN 2 THEN 'Dead-Code' WHEN 3 THEN 'naming' WHEN 4 THEN 'ux' ELSE 'other' END AS type, CASE o_orderkey % 2 WHEN 0 THEN 'ch-01-bugs' ELSE 'ch-03-typescript' END AS chapter FROM orders), y AS (SELECT id, chapter AS from_chapter, CASE id % 6 WHEN 0 THEN 'ch-01-bugs' WHEN 1 THEN 'ch-03-typescript' WHEN 2 THEN 'ch-05-dead-code' WHEN 3 THEN 'ch-03-typescript' WHEN 4 THEN 'ch-08-ux' ELSE 'ch-99-archived' END AS to_chapter FROM x)
    SELECT id, from_chapter, to_chapter FROM y WHERE from_chapter <> to_chapter"""
)
def chapter_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.when(k % 6 == 0, "bugs").when(k % 6 == 1, "type-safety").when(k % 6 == 2, "Dead-Code").when(k % 6 == 3, "naming").when(k % 6 == 4, "ux").otherwise("other")
    rows = views.table(spark, sf_dir, "orders").select(k.alias("id"), t.alias("type"), F.when(k % 2 == 0, "ch-01-bugs").otherwise("ch-03-typescript").alias("chapter"))
    return registers.chapter_moves(rows)


@query(
    """WITH f AS (SELECT DISTINCT id, source_file AS path FROM issues), a AS (SELECT id, count(*) FILTER (CAST(path AS BIGINT) % 3 = 0) AS n_affected, count(*) FILTER (CAST(path AS BIGINT) % 6 = 0) AS n_deleted FROM f GROUP BY 1)
    SELECT id, n_affected, n_deleted, CASE WHEN n_affected > 0 AND n_deleted > 0 THEN 'stale' WHEN n_affected > 0 THEN 'recheck' ELSE 'unchanged' END AS action FROM a""",
    "issues",
)
def issue_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.issues(spark, sf_dir).select("id", F.col("source_file").alias("path"))
    p = f.select("path").distinct()
    return registers.recheck(f, p.filter("cast(path as bigint) % 3 = 0"), p.filter("cast(path as bigint) % 6 = 0"))


@query("""SELECT category, count(*) AS n, count(DISTINCT key) AS merged FROM (SELECT category, substr(lower(regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g')), 1, 60) AS key FROM patterns) GROUP BY 1""".replace("\\\\", "\\"), "patterns")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = registers.merge_patterns(views.patterns(spark, sf_dir))
    return m.groupBy("category").agg(F.sum("n_merged").alias("n"), F.count(F.lit(1)).alias("merged"))


@query(
    r"""WITH k AS (SELECT *, substr(lower(regexp_replace(title, '[^\p{L}\p{N}]', '', 'g')), 1, 60) AS key FROM patterns), g AS (SELECT category, key, count(*) AS n_merged, min(id) AS first_id, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters, count(DISTINCT cluster) AS nc FROM k GROUP BY 1, 2), t AS (SELECT category, key, title FROM k QUALIFY row_number() OVER (PARTITION BY category, key ORDER BY length(title) DESC, id) = 1)
    SELECT category, key, title, clusters, n_merged, first_id, CASE WHEN nc >= 2 THEN 'promoted' ELSE 'candidate' END AS status FROM g JOIN t USING (category, key)""",
    "patterns",
)
def pattern_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.merge_patterns(views.patterns(spark, sf_dir)).withColumn("clusters", F.array_join("clusters", ","))


@query(
    """WITH pc AS (SELECT DISTINCT p_type AS id, p_brand AS cluster FROM part), b AS (SELECT DISTINCT p_brand AS cluster, CAST(right(p_brand, 1) AS INT) AS k FROM part), a AS (SELECT id, count(*) FILTER (k % 2 = 0) AS matched, count(*) FILTER (k % 2 <> 0 AND k <> 3) AS remaining FROM pc JOIN b USING (cluster) GROUP BY 1)
    SELECT id, matched, remaining, CASE WHEN matched = 0 THEN 'unchanged' WHEN remaining < 2 THEN 'orphaned' ELSE 'stale' END AS state FROM a"""
)
def pattern_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    pc = views.table(spark, sf_dir, "part").select(F.col("p_type").alias("id"), F.col("p_brand").alias("cluster")).distinct()
    b = pc.select("cluster").distinct().withColumn("k", F.substring("cluster", -1, 1).cast("int"))
    return registers.pattern_states(pc, b.filter("k % 2 = 0"), b.filter("k <> 3"))


@query(
    r"""WITH n AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS name FROM pages) SELECT DISTINCT page_id AS page, split_part(regexp_replace(href, '^/', ''), '|', 1) AS target FROM links WHERE split_part(regexp_replace(href, '^/', ''), '|', 1) NOT IN (SELECT name FROM n)""", "links"
)
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]*/([a-z]+)/", 1).alias("relpath"))
    got = views.links(spark, sf_dir).select(F.col("page_id").alias("page"), F.regexp_replace("href", "^/", "").alias("target"))
    return registers.broken_links(got, names)


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<h1>')) AS n_h1 FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<h1>")).cast("long").alias("n_h1"))


@query("SELECT token AS name, min(page_id) AS page FROM (SELECT page_id, unnest(string_split(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' ')) AS token FROM pages) GROUP BY 1")
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.posexplode(F.split(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), " ")).alias("pos", "name"))
    return registers.first_definitions(rows).select("name", "page")


@query("SELECT host, count(DISTINCT page_id) AS n_pages, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM links GROUP BY 1", "links")
def book_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.links(spark, sf_dir).groupBy("host").agg(F.count_distinct("page_id").alias("n_pages"), F.count(F.lit(1)).alias("n_links"), F.count_distinct("href").alias("n_targets"))


@query(
    """WITH d AS (SELECT dst AS source, count(*) AS n FROM circles GROUP BY 1), m AS (SELECT DISTINCT node FROM (SELECT src AS node FROM circles UNION ALL SELECT dst FROM circles)), refs AS (SELECT DISTINCT o_orderkey AS page, o_custkey AS path FROM orders), c AS (SELECT DISTINCT x.src AS node FROM circles x JOIN circles y ON x.src = y.dst AND x.dst = y.src)
    SELECT page, path, 'missing' AS "check" FROM refs WHERE path NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT page, path, 'not_in_graph' FROM refs WHERE path NOT IN (SELECT node FROM m) UNION ALL SELECT page, path, 'circular' FROM refs WHERE path IN (SELECT node FROM c) UNION ALL SELECT page, path, 'hot' FROM refs JOIN d ON d.source = path WHERE n >= 4""",
    "circles",
)
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.circles(spark, sf_dir)
    cyc = graph.mutual(e).select(F.explode(F.array("a", "b")).alias("source")).distinct().withColumn("has_circular", F.lit(True))
    modules = e.select(F.explode(F.array("src", "dst")).alias("source")).distinct().join(cyc, "source", "left")
    refs = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("path")).distinct()
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return registers.code_references(refs, docs, modules, graph.dependents(e), 4)


CLAIMS = ("complexity", "bug", "dead_code", "typescript", "complex_logic", "missing_types", "circular_dependency", "potential_bug", "security")


@query(
    f"""WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM circles UNION SELECT r.a, e.dst FROM r JOIN circles e ON e.src = r.b), cyc AS (SELECT DISTINCT a AS path FROM r WHERE a = b), o AS (SELECT o_orderkey AS id, {list(CLAIMS)}[o_orderkey % 9 + 1] AS type, o_custkey AS c FROM orders), i AS (SELECT id, type, unnest([c, c * 5 + 1]) AS path FROM o),
    f AS (SELECT doc_id AS path, CAST(len(string_split(text, chr(10))) AS BIGINT) + doc_id % 300 + 1 AS lines, doc_id % 9 AS depth, CAST(doc_id % 5 AS BIGINT) AS any_count FROM documents), d AS (SELECT node AS path, count(e.dst) AS n FROM (SELECT src AS node FROM circles UNION SELECT dst FROM circles) m LEFT JOIN circles e ON e.dst = m.node GROUP BY 1), n AS (SELECT id, count(*) AS n FROM i JOIN cyc USING (path) GROUP BY 1),
    x AS (SELECT i.*, f.path IS NOT NULL AS here, lines, depth, any_count, d.n AS n_dep, coalesce(n.n, 0) AS circles FROM i LEFT JOIN f USING (path) LEFT JOIN d USING (path) LEFT JOIN n USING (id) WHERE type <> 'security')
    SELECT id, path, 'file_exists' AS "check", CAST(here AS BIGINT) AS actual, here AS passed FROM x UNION ALL SELECT id, path, 'line_count', lines, coalesce(lines > 200, false) FROM x WHERE type IN ('complexity', 'complex_logic') UNION ALL SELECT id, path, 'nesting_depth', depth, coalesce(depth > 4, false) FROM x WHERE type IN ('complexity', 'complex_logic')
    UNION ALL SELECT id, path, 'any_count', any_count, coalesce(any_count >= 3, false) FROM x WHERE type IN ('typescript', 'missing_types') UNION ALL SELECT id, path, 'export_references', n_dep, coalesce(n_dep = 0, false) FROM x WHERE type = 'dead_code' UNION ALL SELECT id, path, 'circular_in_graph', circles, circles > 0 FROM x WHERE type IN ('bug', 'circular_dependency')""",
    "circles",
)
def content_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of two files each, of every type that has checks and one that has none."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("doc_id")
    type_ = F.element_at(F.array(*map(F.lit, CLAIMS)), (k % 9 + 1).cast("int"))
    i = views.table(spark, sf_dir, "orders").select(k.alias("id"), type_.alias("type"), F.array(c, c * 5 + 1).alias("paths"))
    text = F.concat("text", F.repeat(F.lit("\n"), (d % 300 + 1).cast("int")), F.repeat(F.lit("  "), (d % 9).cast("int")), F.lit("x"), F.repeat(F.lit(" as  any"), (d % 5).cast("int")))
    f = views.table(spark, sf_dir, "documents").select(d.alias("path"), text.alias("t")).select("path", code.line_count(F.col("t")).alias("lines"), code.any_count(F.col("t")).alias("any_count"), code.nesting(F.col("t")).alias("depth"))
    e = views.circles(spark, sf_dir)
    n = e.select(F.explode(F.array("src", "dst")).alias("source")).distinct().join(graph.dependents(e), "source", "left").na.fill(0, ["n_dependents"])
    return registers.content_checks(i, f, n, graph.cycles(e).select(F.col("node").alias("path")))


MD = "md AS (SELECT o_orderkey AS id, '---' || chr(10) || 'id: IS-' || o_orderkey || chr(10) || 'type: ' || (CASE o_orderkey % 2 WHEN 0 THEN 'bug' ELSE 'ux' END) || chr(10) || 'source_files: [a' || o_custkey || '.ts, b.ts]' || chr(10) || '---' || chr(10) || 'text' AS raw FROM orders)"


@query("SELECT o_orderkey AS k, 'IS-' || o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'bug' ELSE 'ux' END AS type, 'a' || o_custkey || '.ts,b.ts' AS source_files FROM orders")
def frontmatter_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("---\nid: IS-"), k.cast("string"), F.lit("\ntype: "), F.when(k % 2 == 0, "bug").otherwise("ux"), F.lit("\nsource_files: [a"), F.col("o_custkey").cast("string"), F.lit(".ts, b.ts]\n---\ntext"))
    rows = views.table(spark, sf_dir, "orders").select(k.alias("k"), readers.parse_issue(raw).alias("i"))
    return rows.select("k", "i.id", "i.type", F.array_join("i.source_files", ",").alias("source_files"))


@query("SELECT max(event_id) + 1 AS next FROM (SELECT event_id % 99000 AS event_id FROM events WHERE event_id % 99000 BETWEEN 100 AND 99999)")
def next_issue_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 99000).cast("string")
    rows = views.table(spark, sf_dir, "events").filter("event_id % 99000 between 100 and 99999").select(F.concat(F.lit("IS-"), n, F.lit("-HIGH.md")).alias("name"))
    return registers.next_issue_number(rows).select(F.col("next").cast("long").alias("next"))
