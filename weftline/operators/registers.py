"""Registers of issues, pages and patterns: dedup, validation, roll-ups, cross references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import basename, padded, slug, yaml_text
from weftline.operators.graph import met
from weftline.operators.runs import running
from weftline.operators.tasks import ranked

# Issue types with tier and chapter, severities and states, and names that stand for them.
TIER = {"bug": "P0", "security": "P0", "typescript": "P1", "performance": "P1", "dead_code": "P2", "complexity": "P2", "maintainability": "P2", "ux": "P2"}
CHAPTER = {
    "bug": "ch-01-bugs", "security": "ch-02-security", "typescript": "ch-03-typescript", "performance": "ch-04-performance",
    "dead_code": "ch-05-dead-code", "complexity": "ch-06-complexity", "maintainability": "ch-07-maintainability", "ux": "ch-08-ux",
}
ARCHIVE = "ch-99-archived"
SEVERITIES = ("critical", "high", "medium", "low")
STATUSES = ("detected", "acknowledged", "verified", "fixing", "fixed", "verified_fixed", "archived", "false_positive", "stale", "disputed", "closed", "duplicate")
PENDING = ("detected", "verified", "fixing")
CONFIDENCES = ("high", "medium", "low")
PRIORITY_NAMES = {"critical": "P0 - 致命", "p0": "P0 - 致命", "high": "P1 - 高", "p1": "P1 - 高", "major": "P1 - 高", "medium": "P2 - 中", "p2": "P2 - 中", "low": "P3 - 低", "p3": "P3 - 低", "minor": "P3 - 低", "info": "P3 - 低", "warning": "P3 - 低"}
SEVERITY_NAMES = {"critical": "critical", "p0": "critical", "high": "high", "p1": "high", "major": "high", "medium": "medium", "p2": "medium", "low": "low", "p3": "low", "minor": "low", "info": "low", "warning": "low"}
TYPE_NAMES = {
    **{t: t for t in TIER}, "bugs": "bug", "dead-code": "dead_code", "deadcode": "dead_code", "riskcontrol": "riskcontrol", "edge-case": "bug", "logic-error": "bug", "error-handling": "bug", "type-safety": "typescript",
    "naming": "typescript", "i18n": "maintainability", "constants": "maintainability", "refactor": "complexity", "defensive-programming": "security", "magic-number": "maintainability",
}
# Checks of the types that claim something measurable (older names too), and the limits of checks.
CHECKS = {"line_count": 200, "any_count": 3, "nesting_depth": 4}
CHECKS_OF = {
    "bug": ("file_exists", "circular_in_graph"), "typescript": ("file_exists", "any_count"), "complexity": ("file_exists", "line_count", "nesting_depth"), "dead_code": ("file_exists", "export_references"),
    "complex_logic": ("file_exists", "line_count", "nesting_depth"), "missing_types": ("file_exists", "any_count"), "circular_dependency": ("file_exists", "circular_in_graph"), "potential_bug": ("file_exists",), "inconsistent_api": ("file_exists",),
}
# Pages that are not asked for fields.
ISSUE_PAGES = "volume-2-issues/"
PIPELINE_PAGES = ("PROGRESS.md", "book.md", "glossary.md", "issues.md")
HOT_DEPENDENTS = 10


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def severity_name(raw: Column) -> Column:
    return F.coalesce(looked_up(SEVERITY_NAMES, F.lower(raw)), F.lit("unknown"))


def priority_name(severity: Column) -> Column:
    """The priority that a severity stands for; unknown severities stay."""
    return F.coalesce(looked_up(PRIORITY_NAMES, F.lower(severity)), severity)


def severity_of(priority: Column) -> Column:
    p = F.upper(priority)
    out = F.lit("unknown")
    for k, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(p.startswith(f"P{k}") | (p == name.upper()), name).otherwise(out)
    return out


def type_name(raw: Column, chapter: Column | None = None, file: Column | None = None) -> Column:
    """The known type of a name, else that of its chapter, else of its file's name, else the name itself."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))
    if file is not None:
        f = F.lower(file)
        for k, v in reversed(list(TYPE_NAMES.items())):
            out = F.when(f.contains(k.replace("_", "-")) | f.contains(k), v).otherwise(out)
    if chapter is not None:
        own = F.nullif(F.regexp_replace(chapter, r"^ch-(\d+-)?", ""), F.lit(""))
        out = F.coalesce(looked_up(TYPE_NAMES, own), own, out)
    return F.coalesce(looked_up(TYPE_NAMES, t), out)


def tier_of(type_: Column) -> Column:
    return looked_up(TIER, type_)


def chapter_of(type_: Column) -> Column:
    return F.coalesce(looked_up(CHAPTER, type_), F.lit(ARCHIVE))


def latest_order() -> list[Column]:
    """Issues by severity, then the latest (by the order of words where dates are equal in form), then id."""
    return [severity_order(F.col("severity")), F.desc("detected_at"), F.col("id")]


def latest_first(issues: DataFrame) -> DataFrame:
    return issues.orderBy(*latest_order())


def severity_order(s: Column) -> Column:
    return F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).when(s == "low", 3).otherwise(4)


def dedup(issues: DataFrame, key: list[str], when: str = "detected_at", order: str = "id") -> DataFrame:
    """Adds is_duplicate, duplicate_of (the keeper when the row was met in ``order``), final_keeper.

    The earliest of a key is kept, of equals the first met; no date is the earliest.  Rows without
    an id or a type are left out; arrays of the key count as sets of names in order, and what is
    missing as empty.  All three are running minima, so that a key may have any number of rows.
    """
    text = lambda c: F.array_join(F.array_sort(c), ",") if issues.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    names = [f"_k{k}" for k in range(len(key))]
    given = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in (order, "type") if c in issues.columns]
    rows = issues
    for g in given:
        rows = rows.filter(g)
    own = F.struct(F.coalesce(F.col(when), F.lit("")).alias("w"), F.col(order).alias("o"))
    rows = rows.withColumns({n: F.coalesce(text(c), F.lit("")) for n, c in zip(names, key)})
    rows = running(rows, names, [order], {"_p": ("min", own)})
    record = F.col("_p").isNull() | (own < F.col("_p"))  # it was the keeper when met
    rows = running(rows, names, [order], {"_next": ("min", F.when(record, F.col(order))), "_later": ("min", own)}, behind=True)
    rows = rows.withColumn("final_keeper", F.least(own, "_p", "_later")["o"]).withColumn("is_duplicate", F.col(order) != F.col("final_keeper"))
    return rows.withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.when(record, F.col("_next")).otherwise(F.col("_p.o")))).drop("_p", "_next", "_later", *names)


def violations(issues: DataFrame) -> DataFrame:
    """issues: id, type, severity, status, confidence, chapter (or unknown).  (id, violation, value, level): one row
    for each field that is not allowed; of these only a type must be given."""
    out = lambda name, field, level: F.struct(F.lit(name).alias("violation"), F.col(field).alias("value"), F.lit(level).alias("level"))
    odd = lambda field, known: (F.coalesce(F.col(field), F.lit("")) != "") & ~F.col(field).isin(*known)
    typed = F.col("type").isin(*TIER)
    found = F.array(
        F.when(F.coalesce(F.col("type"), F.lit("")) == "", out("missing_type", "type", "error")).when(~typed, out("invalid_type", "type", "error")),
        F.when(typed & (F.col("chapter") != chapter_of(F.col("type"))) & (F.col("chapter") != "unknown"), out("wrong_chapter", "chapter", "warning")),
        F.when(odd("severity", SEVERITIES), out("invalid_severity", "severity", "warning")), F.when(odd("status", STATUSES), out("invalid_status", "status", "warning")),
        F.when(odd("confidence", CONFIDENCES), out("invalid_confidence", "confidence", "warning")),
    )
    return issues.select("id", F.explode(F.array_compact(found)).alias("v")).select("id", "v.*")


def validator_summary(items: DataFrame, bad: DataFrame) -> DataFrame:
    """total, violations, failed, passed: passed counts items without any."""
    n = items.agg(F.count(F.lit(1)).alias("total"))
    b = bad.agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("id").alias("failed"))
    return n.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k").withColumn("passed", F.col("total") - F.col("failed"))  # one row each


def chapter_moves(issues: DataFrame) -> DataFrame:
    """(id, from_chapter, to_chapter) of issues in another chapter than their type's."""
    to = chapter_of(type_name(F.col("type")))
    return issues.select("id", F.col("chapter").alias("from_chapter"), to.alias("to_chapter")).filter("from_chapter <> to_chapter")


def dashboard(issues: DataFrame) -> DataFrame:
    """(dimension, value, n, pending): counts by status, severity, type and confidence in one pass."""
    rows = issues.withColumn("confidence", F.coalesce("confidence", F.lit("unknown")))
    dims = ("status", "severity", "type", "confidence")
    sets = rows.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_pending")).alias("pending"), F.grouping_id().alias("g"))
    # the grouping id has a bit for each column left out, the first column highest
    name = F.when(F.col("g") == 7, "status").when(F.col("g") == 11, "severity").when(F.col("g") == 13, "type").otherwise("confidence")
    return sets.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n", "pending")


def pending_list(issues: DataFrame, medium: int = 10) -> DataFrame:
    """Pending issues of high severities, and the ``medium`` latest of medium severity."""
    rows = issues.filter(F.col("status").isin(*PENDING) & F.col("severity").isin("critical", "high", "medium"))
    top = rows.filter("severity = 'medium'").orderBy(F.desc("detected_at"), "id").limit(medium)
    return rows.filter("severity <> 'medium'").unionByName(top)


def file_index(issues: DataFrame) -> DataFrame:
    """issues: id, type, severity, status, source_files.  (path, id, type, severity, status), one row for each file
    of an issue, archived ones left out by the caller."""
    return issues.filter("id is not null and type is not null").select(F.explode("source_files").alias("path"), "id", "type", F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("status", F.lit("detected")).alias("status"))


def by_file(issues: DataFrame) -> DataFrame:
    """(source_file, n, critical, high, first_id, last_id): counts alone, as a file may have any number."""
    return issues.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def export_rows(issues: DataFrame) -> DataFrame:
    """issues: id, title, type, severity, status, detected_at, chapter, source, source_files, body, file.

    The eleven columns of the detailed export, with normal names, the priority, the date and a summary.
    """
    severity = severity_name(F.col("severity"))
    return issues.select(
        "id", "title", type_name(F.col("type"), F.col("chapter"), F.col("file")).alias("type"), severity.alias("severity"), priority_name(severity).alias("priority"), "status",
        F.substring("detected_at", 1, 10).alias("date"), "chapter", "source", F.array_join("source_files", "; ").alias("files"), summary(F.col("body")).alias("summary"),
    )


def export_summary(rows: DataFrame) -> DataFrame:
    """(dimension, value, n) of the exported rows: type, severity, priority group, chapter, status, source."""
    rows = rows.withColumn("priority", F.split("priority", " - ")[0])
    dims = ("type", "severity", "priority", "chapter", "status", "source")
    rows = rows.select(*[F.coalesce(d, F.lit("")).alias(d) for d in dims])
    sets = rows.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    all_, name = (1 << len(dims)) - 1, F.lit(None)
    for k, d in enumerate(dims):
        name = F.when(F.col("g") == all_ - (1 << (len(dims) - 1 - k)), d).otherwise(name)
    return sets.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n")


def top_files(issues: DataFrame, k: int = 20) -> DataFrame:
    """(path, n): files in most issues, ties by path."""
    return issues.select(F.explode("source_files").alias("path")).filter("path <> '' and path <> '-'").groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(k)


#: Sections whose beginning sums an issue up, the first that is there.
SUMMARY_SECTIONS = ("问题描述", "检测依据")


def summary(body: Column, most: int = 300) -> Column:
    """The beginning of the section that describes an issue, else of the first line of text."""
    of = lambda name: F.nullif(F.regexp_extract(body, rf"##\s*{name}\s*\n+([\s\S]*?)(?=\n##|\n---|$)", 1), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#") & ~F.trim(x).startswith("---"))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    text = F.coalesce(*[F.regexp_replace(bare(of(n)), "\n", " ") for n in SUMMARY_SECTIONS], bare(F.try_element_at(lines, F.lit(1))), F.lit(""))
    return F.substring(text, 1, most)


def cross_tab(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").pivot("severity", list(SEVERITIES)).count().na.fill(0).withColumn("total", F.expr(" + ".join(SEVERITIES)))


def recheck(issue_files: DataFrame, affected: DataFrame, deleted: DataFrame) -> DataFrame:
    """issue_files: id, path.  (id, n_affected, n_deleted, action): stale only if both are met."""
    rows = issue_files.join(affected.select("path").distinct().withColumn("a", F.lit(1)), "path", "left").join(deleted.select("path").distinct().withColumn("d", F.lit(1)), "path", "left")
    out = rows.groupBy("id").agg(F.count("a").alias("n_affected"), F.count("d").alias("n_deleted"))
    return out.withColumn("action", F.when((F.col("n_affected") > 0) & (F.col("n_deleted") > 0), "stale").when(F.col("n_affected") > 0, "recheck").otherwise("unchanged"))


def content_checks(issues: DataFrame, files: DataFrame, in_degree: DataFrame, in_cycles: DataFrame) -> DataFrame:
    """issues: id, type, paths; files: path, lines, any_count, depth; in_degree: source, n_dependents of all modules;
    in_cycles: path.  (id, path, check, actual, passed): a row for each file and check of an issue whose type claims
    something measurable.

    A file that is missing, or no module of the graph, fails with no actual value.  A circle is found
    if any of the issue's files is in one; actual counts these.
    """
    applies = F.create_map(*[x for t, cs in CHECKS_OF.items() for x in (F.lit(t), F.array(*map(F.lit, cs)))])
    each = issues.select("id", "type", F.posexplode("paths").alias("pos", "path"))
    circles = each.join(met(in_cycles.select("path").distinct()), "path", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("_circles"))
    rows = each.join(met(files.withColumn("_f", F.lit(True))), "path", "left").join(met(in_degree.select(F.col("source").alias("path"), "n_dependents")), "path", "left").join(met(circles), "id", "left")
    rows = rows.withColumn("check", F.explode(applies[F.col("type")]))
    value = {"file_exists": F.coalesce("_f", F.lit(False)).cast("long"), "line_count": F.col("lines"), "any_count": F.col("any_count"), "nesting_depth": F.col("depth"), "export_references": F.col("n_dependents"), "circular_in_graph": F.coalesce("_circles", F.lit(0))}
    actual = F.coalesce(*[F.when(F.col("check") == k, v.cast("long")) for k, v in value.items()])
    ok = F.when(F.col("check") == "line_count", actual > CHECKS["line_count"]).when(F.col("check") == "any_count", actual >= CHECKS["any_count"]).when(F.col("check") == "nesting_depth", actual > CHECKS["nesting_depth"])
    ok = ok.when(F.col("check") == "export_references", actual == 0).otherwise(actual > 0)
    return rows.select("id", "path", "check", actual.alias("actual"), F.coalesce(ok, F.lit(False)).alias("passed"))


def issue_place(text: Column) -> tuple[Column, Column]:
    """(file or symbol, line) that an issue's text names: its line of the place, else the first source with a line."""
    first = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    mark = r"\*\*位置\*\*：`"  # fixed value: how issues name the place
    where = F.coalesce(first(mark + r"([^`]+)`\s*[—–-]\s*`([^`]+)`", 1), first(mark + r"([^`]+)`", 1), first(r"`([^`]+\.[jt]sx?):(\d+)`", 1), F.lit(""))
    line = F.coalesce(first(r"`[^`]*\.([jt]sx?):(\d+)`", 2), first(mark + r"[^`]*?:(\d+)`", 1))
    return F.trim(where), line.try_cast("int")


def verdicts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("id").agg(F.when(F.bool_and("passed"), "verified").otherwise("disputed").alias("verdict"))


def next_issue_number(names: DataFrame, col: str = "name") -> DataFrame:
    n = F.max(F.regexp_extract(col, r"IS-(\d{3,5})", 1).try_cast("int"))
    return names.agg((F.coalesce(n, F.lit(0)) + 1).alias("next"))


def link_target(raw: Column) -> Column:
    """What a link in double brackets leads to: the part before a bar, without white space around."""
    return F.regexp_replace(F.split(raw, r"\|")[0], r"^\s+|\s+$", "")


def wiki_links(pages: DataFrame) -> DataFrame:
    """pages: relpath, text.  (page, target) of the links in their bodies, once each; frontmatter has none."""
    body = F.regexp_replace("text", r"\A---\r?\n[\s\S]*?\n---[ \t]*(\r?\n|\z)", "")
    found = F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return pages.select(F.col("relpath").alias("page"), F.explode(found).alias("raw")).select("page", link_target(F.col("raw")).alias("target")).distinct()


def broken_links(links: DataFrame, pages: DataFrame, whole_paths: bool = False) -> DataFrame:
    """links: page, target; pages: relpath.  (page, target) once for each target that is no page's name."""
    base = F.regexp_replace(F.element_at(F.split("relpath", "/"), -1), r"\.md$", "")
    names = pages.select(base.alias("name"))
    if whole_paths:
        names = names.unionAll(pages.select(F.regexp_replace("relpath", r"\.md$", "").alias("name")))
    return links.select("page", link_target(F.col("target")).alias("target")).distinct().join(names.distinct(), F.col("target") == F.col("name"), "left_anti")


def code_references(refs: DataFrame, files: DataFrame, modules: DataFrame, degree: DataFrame, hot: int = HOT_DEPENDENTS) -> DataFrame:
    """refs: page, path.  (page, path, check): missing, not_in_graph, circular, hot."""
    rows = (
        refs.join(files.select("path").distinct().withColumn("f", F.lit(True)), "path", "left")
        .join(modules.select(F.col("source").alias("path"), "has_circular").withColumn("m", F.lit(True)), "path", "left")
        .join(degree.select(F.col("source").alias("path"), "n_dependents"), "path", "left")
    )
    found = F.array_compact(F.array(
        F.when(F.col("f").isNull(), "missing"), F.when(F.col("m").isNull(), "not_in_graph"), F.when(F.col("has_circular"), "circular"), F.when(F.col("n_dependents") >= hot, "hot"),
    ))
    return rows.select("page", "path", F.explode(found).alias("check"))


#: A word boundary (of A-Z, a-z, 0-9 and _), as a regular expression.
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Symbols that go to a text together.
SYMBOLS_A_TEXT = 1000


def symbol_checks(refs: DataFrame, contents: DataFrame) -> DataFrame:
    """refs: page, path, symbol.  (page, path, symbol, found): the symbol stands in the file between word boundaries
    (of A-Z, a-z, 0-9 and _).

    The distinct symbols of a file go to its text as lists of some ``SYMBOLS_A_TEXT`` at most, so that a
    text is sent once for each list, and each symbol is searched in it; what is found is joined with
    the references by equality.
    """
    asked = refs.filter("symbol <> ''").select("path", "symbol").distinct()
    lists = asked.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / SYMBOLS_A_TEXT).alias("_n"))
    lists = asked.join(lists.hint("merge"), "path").groupBy("path", F.pmod(F.xxhash64("symbol"), "_n").alias("_list")).agg(F.collect_list("symbol").alias("_symbols"))
    text = F.col("content")
    pattern = lambda x: F.concat(F.lit(BOUNDARY + r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + BOUNDARY))
    there = F.filter("_symbols", lambda x: F.when(F.contains(text, x), F.rlike(text, pattern(x))).otherwise(False))
    found = contents.join(lists.hint("merge"), "path").select("path", F.explode(there).alias("symbol")).distinct().withColumn("found", F.lit(True))
    return refs.join(found.hint("merge"), ["path", "symbol"], "left").select("page", "path", "symbol", F.coalesce("found", F.lit(False)).alias("found"))


def missing_fields(pages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """fields: column -> severity.  (relpath, field, severity) of those null or empty; issues' pages and those that
    the pipeline writes are not asked."""
    own = ~F.col("relpath").startswith(ISSUE_PAGES) & ~basename(F.col("relpath")).isin(*PIPELINE_PAGES)
    miss = [F.when(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) == 0, F.struct(F.lit(c).alias("field"), F.lit(s).alias("severity"))) for c, s in fields.items()]
    return pages.filter(own).select("relpath", F.explode(F.array_compact(F.array(*miss))).alias("v")).select("relpath", "v.*")


def first_definitions(symbols: DataFrame) -> DataFrame:
    """symbols: name, page, pos.  The first page, by path, that defines a name."""
    return symbols.groupBy("name").agg(F.min(F.struct("page", "pos")).alias("d")).select("name", "d.page", "d.pos")


def normal_title(t: Column, n: int = 60) -> Column:
    return F.substring(F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")), 1, n)


def merge_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns of a category with one normal title: the longest title (ties: the lowest id), the clusters, the status."""
    merged = patterns.withColumn("key", normal_title(F.col("title"))).groupBy("category", "key").agg(
        F.max_by("title", F.struct(F.length("title"), -F.col("id"))).alias("title"), F.array_sort(F.collect_set("cluster")).alias("clusters"), F.count(F.lit(1)).alias("n_merged"), F.min("id").alias("first_id")
    )
    return merged.withColumn("status", F.when(F.size("clusters") >= 2, "promoted").otherwise("candidate"))


def promote(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """candidates: id, category, status, title, summary, tags, clusters, files, chapters, content, ord; taken: number.

    (number, id, category, key, title, summary, tags, clusters, files, chapters, content, status, n_merged, slug):
    candidates of a category with one normal title (else summary, else id) become one pattern.  Titles,
    summaries and contents are the longest (the first met of equals), lists the sorted union, numbers the
    lowest not taken, in the order met.  Two clusters make a pattern active.
    """
    rows = candidates.filter("status = 'candidate'").withColumn("key", normal_title(F.coalesce(F.nullif("title", F.lit("")), F.nullif("summary", F.lit("")), F.col("id"))))
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("ord")))
    lists = ("tags", "clusters", "files", "chapters")
    out = rows.groupBy("category", "key").agg(*[longest(c).alias(c) for c in ("title", "summary", "content")], F.count(F.lit(1)).alias("n_merged"), F.min("ord").alias("ord"))
    for c in lists:
        union = rows.select("category", "key", F.explode(c).alias("x")).distinct().groupBy("category", "key").agg(F.array_sort(F.collect_list("x")).alias(c))
        out = out.join(union, ["category", "key"], "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    out = ranked(out, [], ["ord"], "place").withColumn("place", F.col("place") + 1)
    # the place-th number that is not taken: place plus the taken numbers below it
    used = taken.select("number").distinct().withColumn("free", F.col("number") - F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("number")))
    before = used.agg(F.array_sort(F.collect_list("free")).alias("frees"))  # of at most 999 numbers
    out = out.withColumn("k", F.lit(1)).join(before.withColumn("k", F.lit(1)), "k").withColumn("number", F.col("place") + F.size(F.filter("frees", lambda f: f < F.col("place"))))
    return out.select(
        "number", F.concat(F.lit("EXP-"), padded(F.col("number"), 3)).alias("id"), "category", "key", "title", "summary", *lists, "content",
        F.when(F.size("clusters") >= 2, "active").otherwise("candidate").alias("status"), "n_merged", slug(F.col("title")).alias("slug"),
    )


def pattern_counts(patterns: DataFrame) -> DataFrame:
    """(category, active, stale, orphaned) of patterns that are shown: candidates are not."""
    s = F.col("status")
    shown = patterns.filter(s != "candidate").withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized")))
    return shown.groupBy("category").agg(F.count_if(s == "active").alias("active"), F.count_if(s == "stale").alias("stale"), F.count_if(s.isin("orphaned", "deprecated")).alias("orphaned"))


def pattern_states(pattern_clusters: DataFrame, affected: DataFrame, existing: DataFrame) -> DataFrame:
    """pattern_clusters: id, cluster.  (id, matched, remaining, state)."""
    rows = pattern_clusters.join(affected.select("cluster").distinct().withColumn("a", F.lit(1)), "cluster", "left").join(existing.select("cluster").distinct().withColumn("e", F.lit(1)), "cluster", "left")
    out = rows.groupBy("id").agg(F.count("a").alias("matched"), F.count_if(F.col("a").isNull() & F.col("e").isNotNull()).alias("remaining"))
    return out.withColumn("state", F.when(F.col("matched") == 0, "unchanged").when(F.col("remaining") < 2, "orphaned").otherwise("stale"))


def artifact_gate(artifacts: DataFrame) -> DataFrame:
    """artifacts: name, text (null: not there), critical.  (name, problem, severity): missing, empty, invalid, ghost
    (three long strings or more), or none (null).

    Only names in .json are read as JSON, and states are no ghosts.  Invalid is an error, a ghost a
    warning; what is missing or empty is an error if the artifact is critical.
    """
    json, state = F.col("name").endswith(".json"), F.col("name").contains("state.json")
    ghost = F.regexp_count("text", F.lit('"[^"]{200,}"')) > 2
    blank = F.col("text").rlike(r"\A\s*\z")
    problem = F.when(F.col("text").isNull(), "missing").when(F.length("text") == 0, "empty").when(json & ~blank & F.try_parse_json("text").isNull(), "invalid").when(json & ~state & ghost, "ghost")
    lighter = F.when(F.col("critical"), "error").otherwise("warning")
    return artifacts.withColumn("problem", problem).select("name", "problem", F.when(F.col("problem") == "invalid", "error").when(F.col("problem") == "ghost", "warning").when(F.col("problem").isNotNull(), lighter).alias("severity"))


def output_checks(tasks: DataFrame, outputs: DataFrame, least: int = 500) -> DataFrame:
    """tasks: id, status, chapter (a folder, or a file in one); outputs: folder, name, size, text (of markers).

    (id, n_pages, is_empty, marked, passed, problem): a completed task needs its folder with pages, any
    other a marker that says who ended and when as well.  Pages are empty, a marker says too little,
    the only page of an open task is short, a marker is missing, the folder is: the first is named.
    """
    name, page = F.col("name"), F.col("name").endswith(".md") & ~F.col("name").startswith(".")
    marker = name == ".gen-done"
    full = F.col("text").rlike(r"(^|\n)subagent: completed") & F.col("text").rlike(r"(^|\n)generated_at:")
    g = outputs.groupBy("folder").agg(
        F.count_if(page).alias("n_pages"), F.count_if(page & (F.col("size") == 0)).alias("n_void"), F.max(F.when(page, F.col("size"))).alias("size"), F.bool_or(marker).alias("has"), F.bool_or(marker & F.coalesce(full, F.lit(False))).alias("marked")
    )
    folder = F.when(F.col("chapter").endswith(".md"), F.regexp_extract("chapter", "^(.*)/[^/]*$", 1)).otherwise(F.col("chapter"))
    rows = tasks.filter("chapter is not null and chapter <> ''").withColumn("folder", folder).join(g.withColumn("there", F.lit(True)), "folder", "left")
    done, there = F.col("status") == "completed", F.coalesce("there", F.lit(False))
    empty = (F.coalesce("n_pages", F.lit(0)) == 0) | (F.col("n_void") > 0)
    marked = F.coalesce("marked", F.lit(False))
    found = (
        F.when(~there, F.when(done, "missing")).when(F.col("n_void") > 0, "empty page").when(F.col("has") & ~marked, "marker incomplete")
        .when(~done & (F.col("n_pages") == 1) & (F.col("size") < least), "short page").when(~done & ~marked & ~empty, "no marker")
    )
    rows = rows.withColumns({"is_empty": F.coalesce(empty, F.lit(True)), "marked": marked, "problem": found, "there": there, "done": done})
    ok = (F.col("marked") & F.col("problem").isNull()) | (~F.col("is_empty") & (F.col("done") | F.col("marked")))
    return rows.select("id", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "is_empty", "marked", (F.col("there") & ok).alias("passed"), "problem")


# Characters and labels of drawings that must not be in names of files, and what they leak from.
LEAK_SIGNS = {"mermaid_rect": "[", "mermaid_diamond": "{", "mermaid_other": "("}
LEAK_LABELS = ("isSub=true", "isSub=false", "circular: true", "circular: false")


def leaked_names(files: DataFrame) -> DataFrame:
    """(path, leak, matched): a name may leak in several ways, of edge labels the first counts."""
    name = basename(F.col("path"))
    label = F.coalesce(*[F.when(name.contains(x), x) for x in LEAK_LABELS])
    struct = lambda kind, what: F.struct(F.lit(kind).alias("leak"), what.alias("matched"))
    found = F.array(*[F.when(name.contains(sign), struct(kind, F.col("path"))) for kind, sign in LEAK_SIGNS.items()], F.when(label.isNotNull(), struct("mermaid_edge", label)))
    return files.select("path", F.explode(F.array_compact(found)).alias("v")).select("path", "v.*")


# Path rules with their weight.
PATH_RULES = {"PATH-001": "CRITICAL", "PATH-002": "CRITICAL", "PATH-003": "CRITICAL", "PATH-004": "REQUIRED", "PATH-005": "CRITICAL", "PATH-006": "CRITICAL"}


def path_checks(paths: DataFrame, files: DataFrame) -> DataFrame:
    """paths: project_root, tool_root, output_root, cache_root, source_root; files: root, path (names in a project's root).

    (project_root, rule, level, passed), six rows a project: it is not the tool's own folder; the output is its
    folder wiki; cache and source lie below it; it has a package.json or src; it is not the tool (agents.md and skills).
    """
    seen = files.groupBy(F.col("root").alias("project_root")).agg(*[F.bool_or(F.col("path") == n).alias(f"_{k}") for k, n in enumerate(("package.json", "src", "agents.md", "skills"))])
    rows = paths.join(seen, "project_root", "left")
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"/(\./)*\.?$", ""), "/(\\./|/)*", "/")
    has = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(False))
    root, below = tidy(F.col("project_root")), lambda c: tidy(F.col(c)).startswith(F.concat(tidy(F.col("project_root")), F.lit("/")))
    ok = {
        "PATH-001": F.col("project_root") != F.col("tool_root"), "PATH-002": tidy(F.col("output_root")) == F.concat(root, F.lit("/wiki")), "PATH-003": below("cache_root"), "PATH-004": below("source_root"),
        "PATH-005": has(0) | has(1), "PATH-006": ~(has(2) & has(3)),
    }
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(PATH_RULES[k]).alias("level"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in ok.items()])
    return rows.select("project_root", F.explode(each).alias("r")).select("project_root", "r.*")


def path_verdicts(checks: DataFrame) -> DataFrame:
    """(project_root, passed, critical_failed, required_failed): a project passes without a critical failure."""
    bad = ~F.col("passed")
    out = checks.groupBy("project_root").agg(F.count_if(bad & (F.col("level") == "CRITICAL")).alias("critical_failed"), F.count_if(bad & (F.col("level") == "REQUIRED")).alias("required_failed"))
    return out.withColumn("passed", F.col("critical_failed") == 0)


def with_field(raw: Column, field: str, value: Column, after: str | None = None) -> Column:
    """A Markdown text with a field of its frontmatter set: its line is replaced, else put in behind that of
    ``after``, else at the beginning."""
    line = F.concat(F.lit(f"{field}: "), value)
    safe = F.regexp_replace(line, r"([\\$])", r"\\$1")
    behind = F.regexp_replace(raw, rf"(?m)^({after}:.*\n)", F.concat(F.lit("$1"), safe, F.lit("\n"))) if after else raw
    begun = F.regexp_replace(raw, r"\A---\n", F.concat(F.lit("---\n"), safe, F.lit("\n")))
    return F.when(raw.rlike(rf"(?m)^{field}:"), F.regexp_replace(raw, rf"(?m)^{field}:.*$", safe)).otherwise(behind if after else begun)


def rewritten(texts: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """texts: id, text; changes: id, action, reason.  Texts of patterns with state, reason and time of changes that are no "unchanged"."""
    quoted = lambda c: F.concat(F.lit('"'), yaml_text(c), F.lit('"'))
    rows = texts.join(changes.filter("action <> 'unchanged'").select("id", "action", "reason"), "id", "left")
    new = with_field(F.col("text"), "status", F.col("action"))
    rows = rows.withColumn("new", new)
    rows = rows.withColumn("new", with_field(F.col("new"), "staleReason", quoted(F.col("reason")), "status"))
    rows = rows.withColumn("new", with_field(F.col("new"), "staleAt", quoted(F.lit(at)), "staleReason"))
    return rows.select("id", F.when(F.col("action").isNotNull(), F.col("new")).otherwise(F.col("text")).alias("text"))


def marked(issues: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Issues with the status of ``changes`` (id, new_status), and an event for each change in ``history``."""
    rows = issues.join(changes, "id", "left")
    event = F.struct(F.lit(now).alias("at"), F.col("status").alias("from"), F.col("new_status").alias("to"))
    history = F.coalesce(F.col("history"), F.expr("cast(array() as array<struct<at:string,from:string,to:string>>)"))
    moved = F.col("new_status").isNotNull() & (F.col("new_status") != F.col("status"))
    return rows.withColumns({"history": F.when(moved, F.array_append(history, event)).otherwise(history), "status": F.when(moved, F.col("new_status")).otherwise(F.col("status"))}).drop("new_status")
