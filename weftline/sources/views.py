"""Deterministic views of the driver's tables that stand for source trees, graphs, tasks and registers.

Each has a Spark form and the same in DuckDB SQL (``SQL``), so that queries can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL: dict[str, str] = {
    "files": """SELECT doc_id, source || '/' || (CASE doc_id % 7 WHEN 0 THEN 'pages/list' WHEN 1 THEN 'components' WHEN 2 THEN 'hooks' WHEN 3 THEN 'utils' WHEN 4 THEN 'types' ELSE lang END) || '/'
        || (CASE WHEN doc_id % 17 = 0 THEN 'index' WHEN doc_id % 13 = 0 THEN 'doc_' || doc_id || '.test' WHEN doc_id % 11 = 0 THEN 'doc_' || doc_id || '.stories' WHEN doc_id % 23 = 0 THEN 'doc_' || doc_id || '.styles' WHEN doc_id % 9 = 0 THEN 'useDoc' || doc_id ELSE 'Doc' || doc_id END)
        || (CASE WHEN doc_id % 19 = 0 THEN '.css' ELSE CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.tsx' WHEN 'de' THEN '.jsx' ELSE '.d.ts' END END) AS path, text AS content FROM documents""",
    "edges": """SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, doc_id // 3 AS dst FROM documents UNION ALL SELECT doc_id, doc_id % 40 FROM documents UNION ALL SELECT doc_id, doc_id // 7 FROM documents WHERE doc_id % 2 = 0) WHERE src <> dst""",
    "circles": """SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, doc_id // 3 AS dst FROM documents UNION ALL SELECT doc_id // 3, doc_id FROM documents WHERE doc_id % 7 = 3 UNION ALL SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 40 < 12 UNION ALL SELECT doc_id, doc_id - 12 FROM documents WHERE doc_id % 40 = 12) WHERE src <> dst""",
    "plan_files": """SELECT CASE WHEN doc_id % 3 = 0 THEN 'l/' || lang ELSE 's' || (CAST(substr(source, 4) AS INT) % 6) END AS folder, 'd' || doc_id || (CASE doc_id % 19 WHEN 0 THEN '.css' ELSE '.ts' END) AS path, CASE WHEN doc_id % 19 = 0 THEN 'P4' WHEN doc_id % 13 = 0 THEN 'P3' WHEN doc_id % 17 = 0 THEN 'P0' WHEN doc_id % 2 = 0 THEN 'P1' ELSE 'P2' END AS priority,
        greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens, doc_id % 11 AS n_dep, CASE WHEN doc_id % 400 = 1 THEN 'other' WHEN doc_id % 17 = 0 THEN 'entry' WHEN doc_id % 5 = 0 THEN 'hooks' WHEN doc_id % 5 = 1 THEN 'utils' WHEN doc_id % 23 = 2 THEN 'types' WHEN doc_id % 5 = 2 THEN 'ui-components' ELSE 'business-components' END AS role, CAST(substr(source, 4) AS INT) % 6 < 3 AS is_barrel FROM documents""",
    "tasks": """SELECT o_orderkey AS id, o_custkey AS folder, CAST(round(o_totalprice) AS BIGINT) AS tokens, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'failed' END AS status, o_orderpriority AS priority FROM orders""",
    "issues": """SELECT event_id AS id, CASE event_id % 10 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' WHEN 2 THEN 'typescript' WHEN 3 THEN 'performance' WHEN 4 THEN 'dead_code' WHEN 5 THEN 'complexity' WHEN 6 THEN 'maintainability' WHEN 7 THEN 'ux' WHEN 8 THEN event_type END AS type,
        CASE WHEN event_id % 6 = 0 THEN 'ch-01-bugs' WHEN event_id % 6 = 1 THEN 'unknown' ELSE 'ch-0' || (1 + event_id % 10) || '-x' END AS chapter,
        CASE WHEN value >= 40 THEN 'critical' WHEN value >= 20 THEN 'high' WHEN value >= 5 THEN 'medium' ELSE 'low' END AS severity, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS detected_at, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS source_file,
        CASE event_id % 7 WHEN 0 THEN 'detected' WHEN 1 THEN 'verified' WHEN 2 THEN 'fixing' WHEN 3 THEN 'open' ELSE 'fixed' END AS status, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN 'sure' ELSE 'low' END AS confidence FROM events""",
    "patterns": """SELECT p_partkey AS id, p_type AS category, p_name AS title, p_brand AS cluster, p_size AS size FROM part""",
    "links": r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
    "after": """SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN text || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id + 100000000, text FROM documents WHERE doc_id % 50 = 7""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    folder = F.when(d % 7 == 0, "pages/list").when(d % 7 == 1, "components").when(d % 7 == 2, "hooks").when(d % 7 == 3, "utils").when(d % 7 == 4, "types").otherwise(F.col("lang"))
    base = (
        F.when(d % 17 == 0, "index").when(d % 13 == 0, name("doc_", d, ".test")).when(d % 11 == 0, name("doc_", d, ".stories"))
        .when(d % 23 == 0, name("doc_", d, ".styles")).when(d % 9 == 0, name("useDoc", d)).otherwise(name("Doc", d))
    )
    ext = F.when(d % 19 == 0, ".css").when(F.col("lang") == "en", ".ts").when(F.col("lang") == "fr", ".tsx").when(F.col("lang") == "de", ".jsx").otherwise(".d.ts")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), folder, F.lit("/"), base, ext).alias("path"), F.col("text").alias("content"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"))
    to = lambda dst: F.expr(dst)
    out = d.select("src", F.explode(F.array(to("src div 3"), to("src % 40"), F.when(F.col("src") % 2 == 0, to("src div 7")))).alias("dst"))
    return out.filter("dst is not null and src <> dst").distinct()


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with circles of two and of many nodes."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    up = F.expr("doc_id div 3")
    pair = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    each = F.array_compact(F.array(pair(k, up), F.when(k % 7 == 3, pair(up, k)), F.when(k % 40 < 12, pair(k, k + 1)), F.when(k % 40 == 12, pair(k, k - 12))))
    return d.select(F.explode(each).alias("e")).select("e.*").filter("src <> dst").distinct()


def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders of which some are large, with roles by their number."""
    k, n = F.col("doc_id"), F.substring("source", 4, 9).cast("int") % 6
    return table(spark, sf_dir, "documents").select(
        F.when(k % 3 == 0, F.concat(F.lit("l/"), "lang")).otherwise(F.concat(F.lit("s"), n.cast("string"))).alias("folder"), F.concat(F.lit("d"), k.cast("string"), F.when(k % 19 == 0, ".css").otherwise(".ts")).alias("path"),
        F.when(k % 19 == 0, "P4").when(k % 13 == 0, "P3").when(k % 17 == 0, "P0").when(k % 2 == 0, "P1").otherwise("P2").alias("priority"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"), (k % 11).alias("n_dep"),
        F.when(k % 400 == 1, "other").when(k % 17 == 0, "entry").when(k % 5 == 0, "hooks").when(k % 5 == 1, "utils").when(k % 23 == 2, "types").when(k % 5 == 2, "ui-components").otherwise("business-components").alias("role"), (n < 3).alias("is_barrel"),
    )


def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a writer leaves them: k, relpath, text; headings, a table, code, links, references and a section of issues."""
    k = F.col("doc_id")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    text = s(
        "---\ntitle: Page ", k, "\ntags: [", F.when(k % 3 == 0, "hook").when(k % 3 == 1, "utils").otherwise("other"), ", x]\nsourceFiles: [f", k % 50, ".ts, f", k % 77, ".ts]\n---\n# Head ", k, "\n## useThing", k % 30,
        "\n### `Widget", k % 40, "`\n| Row", k % 20, " | component | y |\n```ts\nexport function fn", k % 60, "() {}\n```\nSee IS-", 100 + k % 200, "-HIGH, IS-", 100 + k % 90, "-LOW-slug and [[", "doc_", k % 400, "|x]].\n",
        F.when(k % 4 == 0, "## 已知问题\n\n- one\n\n## More\n").when(k % 4 == 1, "## 已知问题\n暂无\n").otherwise(""),
    )
    return table(spark, sf_dir, "documents").select(k.alias("k"), s("ch-", k % 12, "/doc_", k, ".md").alias("relpath"), text.alias("text"))


def issue_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of issue files: those of 100 to 249 of severity HIGH."""
    k = F.col("doc_id") % 150 + 100
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("IS-"), k.cast("string"), F.lit("-HIGH"), F.when(F.col("doc_id") % 2 == 0, "-slug").otherwise(""), F.lit(".md")).alias("name"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("folder"), F.round("o_totalprice").cast("long").alias("tokens"),
        F.when(s == "F", "completed").when(s == "O", "pending").when(s == "P", "in_progress").otherwise("failed").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("value"), F.col("event_id")
    types = F.array(*[F.lit(t) for t in ("bug", "security", "typescript", "performance", "dead_code", "complexity", "maintainability", "ux")])
    return table(spark, sf_dir, "events").select(
        e.alias("id"), F.when(e % 10 < 8, F.element_at(types, (e % 10 + 1).cast("int"))).when(e % 10 == 8, F.col("event_type")).alias("type"),
        F.when(e % 6 == 0, "ch-01-bugs").when(e % 6 == 1, "unknown").otherwise(F.concat(F.lit("ch-0"), (1 + e % 10).cast("string"), F.lit("-x"))).alias("chapter"),
        F.when(v >= 40, "critical").when(v >= 20, "high").when(v >= 5, "medium").otherwise("low").alias("severity"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("detected_at"), F.get_json_object("props", "$.k").alias("source_file"),
        F.when(e % 7 == 0, "detected").when(e % 7 == 1, "verified").when(e % 7 == 2, "fixing").when(e % 7 == 3, "open").otherwise("fixed").alias("status"),
        F.when(e % 4 == 0, None).when(e % 4 == 1, "high").when(e % 4 == 2, "sure").otherwise("low").alias("confidence"),
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("title"), F.col("p_brand").alias("cluster"), F.col("p_size").alias("size"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they might be at a later time: some gone, some changed, some new."""
    d = table(spark, sf_dir, "documents")
    same = d.filter("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return same.unionAll(d.filter("doc_id % 50 = 7").select(F.col("doc_id") + 100000000, "text"))
