"""The llm operators as queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.secrets import find

    return find(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import weigh

    got = weigh(table(spark, sf_dir, "documents"))
    names = {"_source": "source", "_lang": "lang", "_topic": "topic", "_tokens": "n_tokens", "_weight": "weight", "_probability": "probability", "_taken": "taken"}
    return got.select("doc_id", *[F.col(k).alias(v) for k, v in names.items()])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import COUNTS, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return got.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_p_good").alias("p_good"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.jaccard import resolve

    return resolve(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.covertree import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.sharding import shard_documents

    got = shard_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.toxicity import THRESHOLD, held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "distance")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.pseudolikelihood import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.conversations import repair_damaged

    return repair_damaged(table(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontamination import scan

    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))


# What of the operators' results SQL can express: queries that take those columns of them.


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last_slot"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sharding(spark, sf_dir).select("doc_id", "size")


def mixing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing(spark, sf_dir).select("doc_id", "source", "lang", "n_tokens")


QUERIES = {"op1_secrets": op1_secrets, "op2_mixing": op2_mixing, "op3_quality": op3_quality, "op4_jaccard": op4_jaccard, "op5_html": op5_html, "op6_embeddings": op6_embeddings, "op7_sharding": op7_sharding, "op8_packing": op8_packing, "op9_toxicity": op9_toxicity, "op10_lm": op10_lm}
QUERIES |= {"op11_conversations": op11_conversations, "op12_decontamination": op12_decontamination, "op13_alignment": op13_alignment}
QUERIES |= {"secret_counts": secret_counts, "quality_counts": quality_counts, "shard_rows": shard_rows, "shard_sizes": shard_sizes, "mixing_tokens": mixing_tokens}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE: dict[str, str] = {
    "secret_counts": r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex FROM documents""",
    "quality_counts": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents), g AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d)), f AS (SELECT r, k FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
        p AS (SELECT r, count(DISTINCT k + j) AS n FROM f, range(3) x(j) GROUP BY r), l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN p USING (r) LEFT JOIN l USING (r)""",
    "shard_rows": "WITH n AS (SELECT count(*) AS n FROM documents) SELECT CAST(k AS INT) AS shard, CAST(n // 24 + (CASE WHEN k < n % 24 THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(n // 24 + (CASE WHEN k < n % 24 THEN 1 ELSE 0 END) - 1 AS BIGINT) AS last_slot FROM n, range(24) x(k)",
    "shard_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size FROM documents",
    "mixing_tokens": rf"SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST(len({WORDS}) AS BIGINT) AS n_tokens FROM documents",
    "op12_decontamination": rf"""WITH n AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0), win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM n)),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents), g AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win))), m AS (SELECT r, p, k, item_id FROM g JOIN win USING (k, g)),
        h AS (SELECT r, count(DISTINCT p + j) AS n FROM (SELECT DISTINCT r, p, k FROM m), range(10) x(j) WHERE j < k GROUP BY r), t AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
}


def _repair_sql() -> str:
    """Layers of four states as strings, cost in nine digits and then the audit: the least string is the least (cost, audit)."""
    more = lambda v, cost, letters: f"(lpad(CAST(CAST({v}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {v}[10:] || '{letters}')"  # noqa: E731
    when = lambda test, v: f"CASE WHEN {test} THEN {v} END"  # noqa: E731
    keep = "(CASE WHEN fault = 't' THEN 1 ELSE 0 END)"
    c2, c3 = f"least(v2, {more('v0', 2, 'I')}, {more('v1', 2, 'I')}, {more('v3', 2, 'I')})", f"least(v3, {more('v2', 2, 'I')}, {more('v0', 4, 'II')}, {more('v1', 4, 'II')})"
    may = "fault NOT IN ('b', 'd')"
    to_user = [x for v in ("v0", "v1", "c3") for x in (when(f"{may} AND i = 'u'", more(v, keep, "K")), when(may, more(v, f"(2 + {keep})", "R")))]
    new = (more("v0", 3, "D"), f"least({more('v1', 3, 'D')}, {when(may + " AND i = 's'", more('v0', keep, 'K'))})", f"least({more('c2', 3, 'D')}, {', '.join(to_user)})", f"least({more('c3', 3, 'D')}, {when(may + " AND i = 'a'", more('c2', keep, 'K'))}, {when(may, more('c2', f'(2 + {keep})', 'R'))})")
    return rf"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 20 AS x FROM conversations, t),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN x = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE x <> 0)),
        f AS (SELECT *, role[1:1] AS i, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1:1] AS two, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE 'o' END AS fault FROM r),
        g AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM conversations
            UNION ALL SELECT conv_id, n, {new[0]}, {new[1]}, {new[2]}, {new[3]} FROM (SELECT g.conv_id, f.n, f.i, f.fault, v0, v1, {c2} AS c2, {c3} AS c3 FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.n = g.n + 1)),
        e AS (SELECT conv_id, CAST(v[1:9] AS BIGINT) AS cost, v[10:] AS audit FROM (SELECT conv_id, least(v0, v3, {more('v2', 2, 'I')}, {more('v1', 4, 'II')}) AS v FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)),
        z AS (SELECT e.conv_id, p, audit[p] AS l, role, i, text FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM e) e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = len(replace(audit[1:p], 'I', '')) AND audit[p] <> 'I' WHERE audit[p] <> 'D'),
        o AS (SELECT conv_id, p, l, role, text, row_number() OVER w - first_value(CASE WHEN l = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER w AS c FROM z WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
        h AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN c % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS s FROM o GROUP BY conv_id),
        q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(s, '')) AS repaired_sha256
        FROM e LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE["op11_conversations"] = _repair_sql()
