"""Pages of a knowledge base: symbols, references to issues, links back, labels and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import basename, path_id
from weftline.operators.graph import met
from weftline.operators.tasks import ranked

# The form of issue ids, headings of sections, words that say a section is empty.
ISSUE_ID = r"\b(IS-\d{3,5}-(?:CRITICAL|HIGH|MEDIUM|LOW))"
KNOWN_ISSUES = "已知问题"
NO_ISSUES = "暂无"
SECTION_ROLES = ("entry", "ui-components", "cross")
SYMBOL_TYPES = ("component", "hook", "function", "symbol")
TABLE_TYPES = "component|hook|function|type|interface|constant|enum"
TAG_TYPES = (("hook", ("hook", "hooks")), ("component", ("component", "components")), ("type", ("type", "types", "interface")), ("function", ("utility", "utils", "function")), ("constant", ("constant", "constants")), ("enum", ("enum", "enums")))
SOURCE_CHANGE = r"\.(ts|tsx|js|jsx)$"
#: Issues that are told of a page at once (504 values are a run of Parquet's packed numbers, so that equal blocks
#: have equal bytes), parts of a set's issues, and issues for each bucket of a part.
BLOCK, PARTS, BUCKET_ROWS = 504, 4, 4_000_000


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def title(text: Column, own: Column) -> Column:
    """The frontmatter's title, else the first heading, else empty."""
    return F.coalesce(F.nullif(own, F.lit("")), F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)))


def issue_title(text: Column) -> Column:
    """The first heading, else the first of the second level, else a fixed name."""
    one, two = (F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^#{{{k}}}\s+(.+)$", 1)), F.lit("")) for k in (1, 2))
    return F.coalesce(one, two, F.lit("Untitled"))


def type_by_tags(tags: Column) -> Column:
    """The type that a page's tags give its symbols; functions without one."""
    out = F.lit("function")
    for name, words in reversed(TAG_TYPES):
        out = F.when(F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, words))), name).otherwise(out)
    return out


def type_by_name(name: Column) -> Column:
    return F.when(name.rlike("^use[A-Z]"), "hook").when(name.rlike("^[A-Z]"), "component").when(name.rlike("^[a-z]"), "function").otherwise("symbol")


def headed_symbols(pages: DataFrame) -> DataFrame:
    """pages: relpath, text.  (relpath, name, type, pos): names of two letters or more in headings, once a page."""
    names = F.filter(F.array_distinct(all_of(F.col("text"), r"(?m)^#{2,3}\s+`?([A-Za-z_]\w*)`?")), lambda x: F.length(x) >= 2)
    return pages.select("relpath", F.posexplode(names).alias("pos", "name")).select("relpath", "name", type_by_name(F.col("name")).alias("type"), "pos")


def symbols(pages: DataFrame) -> DataFrame:
    """pages: relpath, text, tags, source_files.  (relpath, name, type, file, pos): names in headings, then in
    tables, then in code blocks, each once a page."""
    text = F.col("text")
    by_tag = type_by_tags(F.col("tags"))
    named = lambda xs, kind: F.transform(xs, lambda x: F.struct(x.alias("name"), kind(x).alias("type")))
    head = named(all_of(text, r"(?m)^#{2,4}\s+`?(\w+)`?"), lambda _: by_tag)
    row = rf"(?m)^\|\s*`?([A-Z][A-Za-z_]\w*)`?\s*\|\s*({TABLE_TYPES})\s*\|"
    table = F.arrays_zip(all_of(text, row, 1).alias("name"), all_of(text, row, 2).alias("type"))
    blocks = all_of(text, r"```[\s\S]*?```", 0)
    code = F.flatten(F.transform(blocks, lambda b: all_of(b, r"(?:export\s+)?(?:function|const|class)\s+(\w+)")))
    code = named(F.filter(code, lambda x: ~x.isin("function", "const")), lambda _: by_tag)
    found = pages.select("relpath", F.try_element_at("source_files", F.lit(1)).alias("file"), F.posexplode(F.concat(head, table, code)).alias("pos", "s"))
    first = found.groupBy("relpath", "s.name").agg(F.min(F.struct("pos", "s.type", "file")).alias("x"))
    return first.select("relpath", "name", "x.type", F.coalesce("x.file", F.lit("")).alias("file"), "x.pos")


def symbol_index(found: DataFrame) -> DataFrame:
    """(name, type, file, relpath) of the first page, by path, that has a name."""
    return found.groupBy("name").agg(F.min(F.struct("relpath", "pos", "type", "file")).alias("x")).select("name", "x.type", "x.file", "x.relpath")


def glossary_counts(found: DataFrame) -> DataFrame:
    """(type, n) of distinct names a page."""
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def exploded(pages: DataFrame, key: str = "relpath") -> DataFrame:
    """(key, path) of pages with arrays of source files; empty names are none."""
    return pages.select(key, F.explode("source_files").alias("path")).filter("path <> ''").distinct()


def file_sets(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, source_files.  (key, files): all files of a key, in order, as one value; keys without files are left out."""
    some = rows.select(key, F.filter("source_files", lambda x: x != "").alias("_files")).filter(F.size("_files") > 0)
    return some.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_files")))).alias("files"))


def _issue_sets(issues: DataFrame) -> DataFrame:
    """(theirs, n, path): each set of files that issues have, how many have it, and each of its files."""
    sets = file_sets(issues, "id").groupBy(F.col("files").alias("theirs")).agg(F.count(F.lit(1)).alias("n"))
    return sets.select("theirs", "n", F.explode("theirs").alias("path"))


def page_issues(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """pages: relpath, source_files; issues: id, source_files.  (relpath, n_issues): issues of a page's files, each once.

    Pages and issues with the same files are counted as one each: only distinct sets of files are
    joined, and the answer has a row for each page.  ``page_issue_pairs`` gives the issues themselves.
    """
    own = file_sets(pages, "relpath")
    sets = own.select("files").distinct().select("files", F.explode("files").alias("path"))
    met = sets.join(_issue_sets(issues), "path").select("files", "theirs", "n").distinct().groupBy("files").agg(F.sum("n").alias("n_issues"))
    got = own.join(met, "files", "left").select("relpath", "n_issues")
    return pages.select("relpath").distinct().join(got, "relpath", "left").na.fill(0, ["n_issues"])


def _told(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """rows: files (a set that issues have), and more.  Each row with every issue that has its set: id, and the row's columns.

    Issues travel in blocks, and a block meets all rows of its set before the next one: of the many
    rows that come out some ``BLOCK`` in turn differ in their id alone, and the same ids come again
    for the next row, which column formats keep in a fraction of a byte.  The issues of a set are
    dealt into ``PARTS``, and each lies in one task, so that a file has few ids.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(PARTS * max(1, -(-issues.count() // BUCKET_ROWS))))
    lists = file_sets(issues, "id").groupBy("files", bucket.alias("_b")).agg(F.flatten(F.collect_list(F.array("id"))).alias("_ids"))
    starts = F.sequence(F.lit(1), F.size("_ids"), F.lit(BLOCK))
    blocks = lists.select("files", (F.col("_b") % PARTS).cast("int").alias("_part"), F.explode(F.transform(starts, lambda k: F.slice("_ids", k, BLOCK))).alias("_ids"))
    dealt = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    both = blocks.repartition(n, "files", "_part").join(met(dealt.repartition(n, "files", "_part")), ["files", "_part"])
    return both.select(F.explode("_ids").alias("id"), *[c for c in rows.columns if c != "files"])


def page_issue_pairs(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(relpath, id) once each: as many rows as there are pairs.

    Which files meet is settled by distinct sets of files, so that a pair arises once and is neither
    sorted nor compared with others.
    """
    own = file_sets(pages, "relpath")
    sets = own.select("files").distinct().select("files", F.explode("files").alias("path"))
    pairs = sets.join(_issue_sets(issues), "path").select("files", "theirs").distinct()
    return _told(own.join(pairs, "files").select(F.col("theirs").alias("files"), "relpath"), issues).select("relpath", "id")


def issue_links(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, place, link, line): the lines of every issue's section (see ``page_links``)."""
    return _told(page_links(pages, issues), issues).select("id", "place", "link", "line")


def chapter_figures(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """pages: chapter, relpath, source_files.  (chapter, n_pages, n_files, n_issues): files and issues once a chapter."""
    n = pages.groupBy("chapter").agg(F.count(F.lit(1)).alias("n_pages"))
    files = pages.select("chapter", F.explode("source_files").alias("path")).filter("path <> ''").distinct()
    f = files.groupBy("chapter").agg(F.count(F.lit(1)).alias("n_files"))
    i = files.join(_issue_sets(issues), "path").select("chapter", "theirs", "n").distinct().groupBy("chapter").agg(F.sum("n").alias("n_issues"))
    return n.join(f, "chapter", "left").join(i, "chapter", "left").na.fill(0, ["n_files", "n_issues"])


def book_figures(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row: n_chapters, n_pages, n_symbols, n_files."""
    files = exploded(pages).agg(F.count_distinct("path").alias("n_files"))
    n = pages.agg(F.count_distinct("chapter").alias("n_chapters"), F.count(F.lit(1)).alias("n_pages"))
    return n.withColumn("k", F.lit(1)).join(found.agg(F.count(F.lit(1)).alias("n_symbols")).withColumn("k", F.lit(1)), "k").join(files.withColumn("k", F.lit(1)), "k").drop("k")


def chapter_labels(chapters: DataFrame, clusters: DataFrame, folders: DataFrame) -> DataFrame:
    """chapters: chapter; clusters: id, label; folders: path.  (chapter, label): the cluster's label, else the
    folder whose id the chapter has, else the name with / for _."""
    name = F.regexp_replace("chapter", "^ch-", "")
    rows = chapters.select("chapter", name.alias("name")).distinct()
    c = clusters.groupBy(F.col("id").alias("name")).agg(F.min("label").alias("c"))
    f = folders.groupBy(F.lower(F.regexp_replace("path", "[^a-zA-Z0-9_-]", "_")).alias("name")).agg(F.min("path").alias("f"))
    return rows.join(c, "name", "left").join(f, "name", "left").select("chapter", F.coalesce("c", "f", F.regexp_replace("name", "_", "/")).alias("label"))


def page_links(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """pages: relpath, source_files; issues: id, source_files.  (files, place, link, line): the lines of the section that
    lists the pages of an issue's files, in order from 0, once for all issues with these files.

    ``file_sets`` of issues says which section is whose: a section is neither repeated for each issue
    nor gathered into one value.
    """
    target = F.regexp_replace(F.concat(F.split("relpath", "/")[0], F.lit("/"), basename(F.col("relpath"))), r"\.md$", "")
    rows = _issue_sets(issues).join(exploded(pages), "path").select(F.col("theirs").alias("files"), target.alias("link")).distinct()
    return ranked(rows, ["files"], ["link"], "place").select("files", "place", "link", F.concat(F.lit("- [["), "link", F.lit("]]")).alias("line"))


def issue_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(all_of(text, ISSUE_ID)))


def issue_files(names: DataFrame) -> DataFrame:
    """names: name (of a file).  (id): issues that have a file."""
    return names.select(F.regexp_extract(F.col("name"), r"^(IS-\d{3,5}-(?:CRITICAL|HIGH|MEDIUM|LOW))", 1).alias("id")).filter("id <> ''").distinct()


def references(pages: DataFrame, names: DataFrame) -> DataFrame:
    """pages: relpath, text; names: name.  (relpath, id, resolved) of the issues that pages name."""
    refs = pages.select("relpath", F.explode(issue_ids(F.col("text"))).alias("id"))
    return refs.join(issue_files(names).withColumn("there", F.lit(True)), "id", "left").select("relpath", "id", F.col("there").isNotNull().alias("resolved"))


def known_issues(text: Column) -> Column:
    """The section of known issues up to the next heading of its level, trimmed; null if there is none to speak of."""
    body = F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?m)^##\s*{KNOWN_ISSUES}[^\S\n]*$([\s\S]*)", 1), r"(?m)^##\s[\s\S]*", ""))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.when((body != "") & ~body.startswith(NO_ISSUES), body)


def section_checks(tasks: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """tasks: id, folder, role, status, relpath (its page); pages: relpath, text; names: name (issue files).

    (id, n_referenced, n_orphaned, no_section, passed) of completed tasks of main roles whose page is
    there: every issue the page names must have a file, if it has a section of known issues; without
    one a folder's first entry task passes, other tasks are not listed.
    """
    rows = tasks.filter((F.col("status") == "completed") & F.col("role").isin(*SECTION_ROLES)).join(pages, "relpath")
    rows = rows.withColumn("has", known_issues(F.col("text")).isNotNull())
    plain = rows.filter(~F.col("has") & (F.col("role") == "entry")).groupBy("folder").agg(F.min("id").alias("id"))
    plain = plain.select("id", F.lit(0).cast("long").alias("n_referenced"), F.lit(0).cast("long").alias("n_orphaned"), F.lit(True).alias("no_section"), F.lit(True).alias("passed"))
    refs = rows.filter("has").select(F.col("id").alias("task"), F.explode_outer(issue_ids(F.col("text"))).alias("ref"))
    refs = refs.join(issue_files(names).select(F.col("id").alias("ref"), F.lit(1).alias("there")), "ref", "left")
    full = refs.groupBy(F.col("task").alias("id")).agg(F.count("ref").alias("n_referenced"), F.count_if(F.col("ref").isNotNull() & F.col("there").isNull()).alias("n_orphaned"))
    return plain.unionByName(full.withColumns({"no_section": F.lit(False), "passed": F.col("n_orphaned") == 0}))


def misplaced(paths: DataFrame) -> DataFrame:
    """paths: relpath below the base.  (relpath, location): issue files in the root of the issue volume,
    or in a chapter's issue folder of the code volume."""
    p = F.col("relpath")
    where = F.when(p.rlike(r"^volume-2-issues/IS-[^/]*\.md$"), "volume-2-root").when(p.rlike(r"^volume-1-code/ch-[^/]*/issues/IS-[^/]*\.md$"), "volume-1-code")
    return paths.select("relpath", where.alias("location")).filter("location is not null")


def meta_rows(cluster_files: DataFrame, meta: DataFrame, most: int = 5) -> DataFrame:
    """cluster_files: cluster, path; meta: path, component, hooks, exports, is_component, has_jsx.

    (cluster, path, component, hooks, exports): table cells, dashes for what is not known, ``most``
    exports at most.
    """
    dash = F.lit("—")
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), dash)
    flag = F.when(F.col("is_component") | F.col("has_jsx"), " ✅").otherwise("")
    rows = cluster_files.join(meta.withColumn("known", F.lit(True)), "path", "left")
    name = F.concat(F.coalesce(F.nullif(F.col("component"), F.lit("")), dash), F.coalesce(flag, F.lit("")))
    return rows.select("cluster", "path", F.when(F.col("known"), name).otherwise(dash).alias("component"), listed(F.col("hooks")).alias("hooks"), listed(F.slice("exports", 1, most)).alias("exports"))


def affected_clusters(cluster_files: DataFrame, affected: DataFrame) -> DataFrame:
    """(cluster): clusters with an affected file."""
    return cluster_files.join(affected.select("path").distinct(), "path", "left_semi").select("cluster").distinct()


def chapter_tasks(chapters: DataFrame, tasks: DataFrame) -> DataFrame:
    """chapters: chapter (a folder with pages), files (array of its page names); tasks: id, folder, chapter.

    (id, found): the task's own path if it names a file or a folder that is there, else the chapter
    that its folder's name gives.
    """
    there = chapters.select("chapter").unionAll(chapters.select(F.explode(F.transform("files", lambda f: F.concat(F.col("chapter"), F.lit("/"), f))).alias("chapter"))).distinct()
    own = tasks.join(there.withColumn("own", F.col("chapter")), "chapter", "left").select("id", "folder", "chapter", "own")
    key = F.lower(F.regexp_replace("folder", r"[/\\]", "_"))
    by_name = chapters.groupBy(F.lower(F.regexp_replace("chapter", "^ch-", "")).alias("key")).agg(F.min("chapter").alias("named"))
    rows = own.withColumn("key", key).join(by_name, "key", "left")
    file = F.coalesce(F.col("chapter").contains("/"), F.lit(False))
    return rows.select("id", F.when(file, F.regexp_extract("own", "^(.*)/[^/]*$", 1)).otherwise(F.coalesce("own", F.when(F.col("folder") != "", F.col("named")))).alias("found"))


def folder_task(folders: DataFrame, tasks: DataFrame) -> DataFrame:
    """folders: path; tasks: id, folder, ord.  (path, id): the first task of the folder, or whose id begins
    with the folder's.

    Ids are cut at every length up to the longest folder id, so that the prefix is a join on
    equality; both tables are lists of a project's folders and tasks.
    """
    f = folders.select("path", path_id(F.col("path")).alias("key")).distinct()
    keys = f.select("key").distinct()
    sized = keys.groupBy(F.length("key").alias("n")).agg(F.count(F.lit(1)).alias("c")).agg(F.array_sort(F.collect_list("n")).alias("ns")).first()["ns"]  # lengths of names, not names
    cuts = F.array_compact(F.array(*[F.when(F.length("id") >= n, F.substring("id", 1, n)) for n in sized])) if sized else F.array().cast("array<string>")
    begun = tasks.select("id", "ord", F.explode(cuts).alias("key")).join(keys, "key").join(f, "key").select("path", "id", "ord")
    same = tasks.join(f.select(F.col("path").alias("folder")), "folder").select(F.col("folder").alias("path"), "id", "ord")
    return begun.unionAll(same).groupBy("path").agg(F.min_by("id", "ord").alias("id"))


def changed_sources(changes: DataFrame, prefix: str = "") -> DataFrame:
    """changes: path (of the repository), status.  Source files below ``prefix``, with paths below it."""
    p = F.col("path")
    rows = changes.filter(p.rlike(SOURCE_CHANGE) & ~p.contains("node_modules"))
    if not prefix:
        return rows
    inside = (p == prefix) | p.startswith(f"{prefix}/") | p.startswith(f"{prefix}\\")
    return rows.filter(inside).withColumn("path", F.regexp_replace(F.substring(p, len(prefix) + 1, 1 << 20), r"^[\\/]", ""))


def in_locale_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as a reader expects words in order: letters before their case and accents."""
    return df.orderBy(*[F.collate(F.col(c), "UNICODE") for c in columns])


def remaining(cluster_files: DataFrame, roots: DataFrame) -> DataFrame:
    """(cluster, path) of the files that are no roots."""
    return cluster_files.join(roots.select("cluster", "path"), ["cluster", "path"], "left_anti")
