"""Sources and sinks: trees of files, frontmatter, Markdown tables, change lists, state, CSV and JSON."""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.code import ASSET_DIRECTORY, SOURCE_EXTENSIONS, is_styled_module
from weftline.functions.paths import extname, normalized, relative
from weftline.sources import ignores

# Directories that a scan leaves out; keys with other names in issue files.
IGNORED = r"(^|/)(node_modules|dist|build|coverage|\.git|\.next|\.nuxt|out|vendor)/"
ALIASES = {"issueId": "id", "detectedAt": "detected_at", "sourceFile": "source_files"}
TABLE_LABELS = ("ID", "Type", "Severity", "Status", "Confidence", "Detected", "Source")


def scan_tree(spark: SparkSession, root: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(path, content binary, bytes) of source files below ``root``, sorted by path later where order counts.

    What the ignore files of the root and of folders name is left out (see ``ignores``).  A folder that
    is not there is an error.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    rows = rows.select(relative(path, "/" + root.split(":", 1)[-1].strip("/")).alias("path"), "content", F.col("length").alias("bytes"))
    return ignores.kept(source_files(rows, extra), ignores.rules(ignores.read(spark, root)))


def source_files(files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose path has a source extension and no ignored directory; among assets, source files only."""
    known = [f".{e}" for e in (*SOURCE_EXTENSIONS, *(x.lstrip(".") for x in extra))]
    source = extname(F.col("path")).isin(*[f".{e}" for e in SOURCE_EXTENSIONS])
    return files.filter(extname(F.col("path")).isin(*known) & ~F.col("path").rlike(IGNORED) & (~F.col("path").rlike(ASSET_DIRECTORY) | source))


def by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(extname(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def style_split(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with a reason)."""
    flag = is_styled_module(F.col("path"))
    return files.filter(~flag), files.filter(flag).select("path", F.lit("styling module").alias("reason"), F.lit("style").alias("filter_type"))


def hashes(files: DataFrame, exclude: str | None = None) -> DataFrame:
    rows = files.filter(~F.col("path").rlike(exclude)) if exclude else files
    return rows.filter("content is not null").select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def import_edges(contents: DataFrame) -> DataFrame:
    """(src, specifier, type) from import and export statements; types of dependency as ``dependency_type``."""
    pattern = r"""(?:import|export)\s[^'";]*?from\s*['"]([^'"]+)['"]|import\s*['"]([^'"]+)['"]|(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)"""
    rows = contents.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))
    spec = F.regexp_extract("m", r"""['"]([^'"]+)['"]""", 1)
    return rows.select("src", spec.alias("specifier")).withColumn("type", dependency_type(F.col("specifier")))


def path_patterns(settings: DataFrame) -> DataFrame:
    """settings: project, text (JSON with compilerOptions.baseUrl and .paths).  (project, head, tail, targets): patterns
    before and behind their star (tail null without one), and the paths that they stand for, from the base."""
    kind = "compilerOptions struct<baseUrl string, paths map<string, array<string>>>"
    rows = settings.select("project", F.from_json("text", kind)["compilerOptions"].alias("o"))
    base = F.regexp_replace(F.regexp_replace(F.coalesce("o.baseUrl", F.lit("")), r"^\./?", ""), "/$", "")
    rows = rows.select("project", base.alias("base"), F.explode("o.paths").alias("pattern", "targets"))
    star = F.col("pattern").contains("*")
    target = F.transform("targets", lambda t: F.regexp_replace(F.concat(F.col("base"), F.lit("/"), F.regexp_replace(t, r"^\./", "")), "^/", ""))
    return rows.select("project", F.split("pattern", r"\*")[0].alias("head"), F.when(star, F.regexp_extract("pattern", r"\*(.*)$", 1)).alias("tail"), target.alias("targets"))


def pattern_paths(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """edges: project, src, specifier.  Adds paths: what the project's pattern for a specifier stands for, in order; null
    if none fits.

    A pattern without a star must be the specifier; else that with the longest beginning counts.  Each
    specifier lists its beginnings of the lengths that patterns have, for a join on equality.
    """
    lengths = [r.n for r in patterns.select(F.length("head").alias("n")).distinct().collect()]  # of a project's settings: few
    s = F.col("specifier")
    cuts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length(s))
    each = edges.select("project", "specifier").distinct().withColumn("_n", F.explode(cuts)).withColumn("head", F.expr("left(specifier, _n)"))
    met = each.join(patterns, ["project", "head"])
    fits = (F.col("tail").isNull() & (F.length(s) == F.col("_n"))) | (s.endswith(F.coalesce("tail", F.lit(""))) & (F.length(s) >= F.col("_n") + F.length("tail")))
    middle = F.expr("substring(specifier, _n + 1, length(specifier) - _n - length(coalesce(tail, '')))")
    paths = F.transform("targets", lambda t: F.when(F.col("tail").isNull(), t).otherwise(F.concat(F.split_part(t, F.lit("*"), F.lit(1)), middle, F.split_part(t, F.lit("*"), F.lit(2)))))
    best = met.filter(fits).groupBy("project", "specifier").agg(F.max_by(paths, F.struct(F.col("tail").isNull().alias("exact"), "_n")).alias("paths"))
    return edges.join(best, ["project", "specifier"], "left")


def resolved_imports(edges: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """edges: src, specifier; files: path.  (src, specifier, dst, type): the file that a specifier stands for, with an
    extension or an index file put behind it where it has none; without one it is external.

    aliases: beginnings that stand for folders, such as @/ for src/.  patterns: of ``path_patterns``, then
    edges have a project; relative specifiers are not asked.  Every way to read a specifier is a row of
    a join on equality; the first that is a file counts.
    """
    s = F.col("specifier")
    for start, folder in (aliases or {}).items():
        s = F.when(F.col("specifier").startswith(start), F.concat(F.lit(f"/{folder}"), F.substring("specifier", len(start) + 1, 1 << 16))).otherwise(s)
    own = F.when(F.col("src").contains("/"), F.regexp_extract("src", "^(.*)/[^/]*$", 1)).otherwise("")
    joined = F.when(s.startswith("."), F.concat(own, F.lit("/"), s)).when(s.startswith("/"), s)
    given = F.lit(None).cast("array<string>")
    if patterns is not None:
        edges, given = pattern_paths(edges, patterns), F.when(~s.startswith("."), F.col("paths"))
    starts = F.coalesce(given, F.when(joined.isNotNull(), F.array(joined)))

    def plain(x: Column) -> Column:
        parts = F.filter(F.split(x, "/"), lambda y: (y != "") & (y != "."))
        up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, y: F.when(y == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, y)))
        return F.array_join(up, "/")

    ways = ["", *[f".{e}" for e in SOURCE_EXTENSIONS], *[f"/index.{e}" for e in SOURCE_EXTENSIONS]]
    tries = F.flatten(F.transform(starts, lambda x: F.array(*[F.concat(plain(x), F.lit(w)) for w in ways])))
    rows = edges.select("src", "specifier", F.posexplode_outer(tries).alias("way", "path"))
    found = rows.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    out = found.groupBy("src", "specifier").agg(F.min_by("path", F.when(F.col("there"), F.col("way"))).alias("dst"))
    return out.withColumn("type", F.when(F.col("dst").isNotNull(), "local").otherwise("external"))


ANALYSIS = """modules array<struct<source string, dependencies array<struct<resolved string, module string, moduleName string, couldNotResolve string, circular boolean, cycle boolean>>>>,
    summary struct<violations array<struct<rule struct<name string, severity string>, `from` string, `to` string, cycle array<string>>>>"""


def analysis(raw: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """raw: text, what a dependency analyser prints, a document a row.  (modules source, ord; edges src, dst, type,
    circular, ord for ``graph.build``; violations for ``graph.violation_cycles``).

    Paths are from ``root``; what is not below it has no leading steps up and no package folder.  Modules
    of packages are left out.  Values that are no text count as they are printed, false as none.
    """
    rows = raw.select(F.monotonically_increasing_id().alias("doc"), F.from_json("text", ANALYSIS).alias("a"))
    modules = rows.select("doc", F.posexplode("a.modules").alias("at", "m")).filter(~F.col("m.source").contains("node_modules"))
    bare = lambda c: F.when(c == "false", "").otherwise(F.coalesce(c, F.lit("")))

    def below(path: Column) -> Column:
        inside = path.startswith(f"{root.rstrip('/')}/")
        outside = F.regexp_replace(F.regexp_replace(path, r"^(\.\./)+", ""), "^.*?node_modules/", "")
        return normalized(F.when(inside, F.substring(path, len(root.rstrip("/")) + 2, 1 << 16)).otherwise(F.coalesce(F.nullif(outside, F.lit("")), path)))

    named = modules.select("doc", "at", below(F.col("m.source")).alias("src"), "m.dependencies")
    each = named.select("doc", "at", "src", F.posexplode("dependencies").alias("k", "d"))
    d = {k: bare(F.col(f"d.{k}")) for k in ("resolved", "couldNotResolve", "moduleName", "module")}
    t = dependency_target(d["resolved"], d["couldNotResolve"], d["moduleName"], d["module"])
    edges = each.withColumn("t", t).withColumn("near", below(F.col("t.target")))
    dst = F.when(F.col("t.type") == "local", F.col("near")).otherwise(F.col("t.target"))
    circular = F.coalesce("d.circular", F.lit(False)) | F.coalesce("d.cycle", F.lit(False))
    ord_ = F.struct("doc", "at", "k")
    edges = edges.select("src", dst.alias("dst"), F.col("t.type").alias("type"), circular.alias("circular"), ord_.alias("ord"))
    violations = rows.select(F.explode("a.summary.violations").alias("v")).select(F.col("v.rule.name").alias("rule"), normalized(F.coalesce("v.from", F.lit(""))).alias("from"), normalized(F.coalesce("v.to", F.lit(""))).alias("to"), F.col("v.cycle").alias("cycle"), F.col("v.rule.severity").alias("severity"))
    return named.select(F.col("src").alias("source"), F.struct("doc", "at").alias("ord")), edges, violations


def dependency_target(resolved: Column, unresolved: Column, name: Column, specifier: Column) -> Column:
    """struct<type, target> of a raw dependency: what is not resolved, or is a package, is external under its name;
    else the path, normalised; without a path a relative specifier is local."""
    text = lambda c: F.coalesce(c, F.lit(""))
    first = lambda *cs: F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cs], F.lit(""))
    outside = (text(unresolved) != "") | text(resolved).contains("node_modules")
    bare = (text(specifier) != "") & ~text(specifier).startswith(".")
    kind = F.when(outside, "external").when(text(resolved) != "", "local").when(bare, "external").otherwise("local")
    target = F.when(outside, first(name, specifier, unresolved, resolved)).when(text(resolved) != "", normalized(resolved)).when(bare, first(name, specifier)).otherwise(normalized(first(specifier, unresolved)))
    return F.struct(kind.alias("type"), target.alias("target"))


def dependency_type(specifier: Column) -> Column:
    return F.when(specifier.rlike(r"^(\.{1,2}/|/|@/|~/)"), "local").when(specifier.contains("node_modules"), "external").otherwise("external")


def name_status(lines: DataFrame, col: str = "value") -> DataFrame:
    """(path, status) of ``diff --name-status`` lines; a rename is a change of its new path."""
    parts = F.split(F.col(col), "\t")
    code = F.substring(parts[0], 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "deleted").otherwise("modified")
    return lines.filter(F.trim(col) != "").select(F.element_at(parts, -1).alias("path"), status.alias("status"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) between two (path, sha256) snapshots."""
    b, a = before.select("path", F.col("sha256").alias("b")), after.select("path", F.col("sha256").alias("a"))
    both = b.join(a, "path", "full")
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", status.alias("status")).filter("status is not null")


def frontmatter(raw: Column, aliases: bool = True, block_lists: bool = True, strip_quotes: bool = True) -> Column:
    """map<string, string> of the block between --- lines: ``key: value`` lines, lists joined by newlines.

    Inline lists ``[a, b]`` and, with ``block_lists``, lines ``- x`` below a bare key become lists.
    """
    block = F.regexp_extract(F.regexp_replace(raw, "\r\n", "\n"), r"^---\n([\s\S]*?)\n---", 1)
    if block_lists:  # fold "- x" lines into the line of their key
        block = F.regexp_replace(block, r"\n\s*-\s+", "\u0001")
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    clean = lambda x: F.regexp_replace(F.trim(x), r"""^["'](.*)["']$""", "$1") if strip_quotes else F.trim(x)

    def value(line: Column) -> Column:
        v = F.trim(F.regexp_replace(line, r"^[A-Za-z_][\w-]*\s*:", ""))
        inline = F.split(F.regexp_replace(v, r"^\[|\]$", ""), ",")
        listed = F.filter(F.split(v, "\u0001"), lambda x: F.trim(x) != "")
        return (
            F.when(v.rlike(r"^\[.*\]$"), F.array_join(F.filter(F.transform(inline, clean), lambda x: x != ""), "\n"))
            .when(v.contains("\u0001"), F.array_join(F.transform(listed, clean), "\n"))
            .otherwise(clean(v))
        )

    key = lambda line: F.trim(F.regexp_extract(line, r"^([A-Za-z_][\w-]*)\s*:", 1))
    named = lambda k: F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[k], k) if aliases else k
    entries = F.transform(lines, lambda x: F.struct(named(key(x)), value(x)))
    last = F.aggregate(entries, F.expr("cast(map() as map<string, string>)"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["col1"]), F.create_map(e["col1"], e["col2"])))
    return last


def listed(values: Column) -> Column:
    """A frontmatter value as an array; a single value is an array of one."""
    return F.filter(F.split(F.coalesce(values, F.lit("")), "\n"), lambda x: x != "")


def table_fields(raw: Column) -> Column:
    """map<label, value> of ``| **Label** | value |`` rows; back quotes around values go."""
    rows = F.regexp_extract_all(raw, F.lit(r"\|\s*\*\*([^*|]+)\*\*\s*\|\s*([^|\n]*)\|"), F.lit(0))
    pair = lambda r: F.struct(F.trim(F.regexp_extract(r, r"\*\*([^*|]+)\*\*", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(r, r"\*\*\s*\|\s*([^|\n]*)\|", 1)), "^`|`$", "").alias("v"))
    return F.aggregate(F.transform(rows, pair), F.expr("cast(map() as map<string, string>)"), lambda acc, e: F.when(F.map_contains_key(acc, e["k"]), acc).otherwise(F.map_concat(acc, F.create_map(e["k"], e["v"]))))


def parse_issue(raw: Column) -> Column:
    """struct<id, type, severity, status, detected_at, confidence, source_files>: frontmatter, else the table."""
    f, t = frontmatter(raw), table_fields(raw)
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[^\x20-\x7E]", "")))
    get = lambda k, label, low=False: F.coalesce(F.nullif(f[k], F.lit("")), plain(t[label]) if low else t[label])
    return F.struct(
        get("id", "ID").alias("id"), get("type", "Type").alias("type"), get("severity", "Severity", True).alias("severity"), get("status", "Status").alias("status"),
        get("detected_at", "Detected").alias("detected_at"), get("confidence", "Confidence", True).alias("confidence"), listed(get("source_files", "Source")).alias("source_files"),
    )


def page_source(raw: DataFrame) -> DataFrame:
    """(relpath, chapter, title, tags, source_files, size, body) of Markdown pages (relpath, text)."""
    f = frontmatter(F.col("text"), aliases=False)
    tags = F.filter(F.transform(F.split(F.coalesce(f["tags"], F.lit("")), "[\n,]"), F.trim), lambda x: x != "")
    heading = F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)
    return raw.select(
        "relpath", F.when(F.col("relpath").contains("/"), F.split("relpath", "/")[0]).otherwise("uncategorized").alias("chapter"),
        F.coalesce(F.nullif(f["title"], F.lit("")), F.nullif(heading, F.lit("")), F.regexp_replace(F.element_at(F.split("relpath", "/"), -1), r"\.md$", "")).alias("title"),
        tags.alias("tags"), listed(f["sourceFiles"]).alias("source_files"), F.length("text").cast("long").alias("size"), F.regexp_replace("text", r"^---\n[\s\S]*?\n---\n?", "").alias("body"),
    )


def csv_text(c: Column) -> Column:
    """RFC 4180 quoting."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_export(df: DataFrame, path: str) -> None:
    """One CSV file of a report, with a byte order mark; rows pass the driver one partition at a time."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(",".join(df.columns) + "\n")
        for (line,) in df.select(F.concat_ws(",", *[csv_text(F.col(c)) for c in df.columns])).toLocalIterator():
            f.write(line + "\n")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def update_state(path: str, change: Callable[[dict], dict], timeout: float = 10.0, version: int = 1) -> dict:
    """Replaces a JSON document as a whole under a lock folder; what holds the lock must be alive."""
    lock, until = f"{path}.lock", time.monotonic() + timeout
    while True:
        try:
            os.mkdir(lock)
            break
        except FileExistsError:
            try:
                with open(f"{lock}/pid") as f:
                    os.kill(int(f.read() or 0), 0)
            except (OSError, ValueError):
                if time.time() - os.path.getmtime(lock) > 1:
                    release(lock)
                    continue
            if time.monotonic() > until:
                raise TimeoutError(f"{lock} is held") from None
            time.sleep(0.02)
    try:
        with open(f"{lock}/pid", "w") as f:
            f.write(str(os.getpid()))
        state = {}
        if os.path.exists(path):
            with open(path) as f:
                state = json.load(f)
        if state.get("schemaVersion", version) > version:
            raise ValueError("the state has a newer schema")
        state = change(state)
        if os.path.exists(path):
            shutil.copyfile(path, f"{path}.backup")
        with open(f"{path}.tmp", "w") as f:
            json.dump(state, f, indent=2)
        os.replace(f"{path}.tmp", path)  # the old document stays whole until the new one is
        return state
    finally:
        release(lock)


def state_errors(state: dict, version: int = 1) -> list[str]:
    """What a state lacks; fields of a nested document by their path."""
    out = [] if 1 <= (state.get("schemaVersion") or 0) <= version else ["schemaVersion"]
    out += [k for k in ("id", "projectPath", "currentPhase", "checkpoint", "config") if not state.get(k)]
    out += [] if isinstance(state.get("phaseHistory"), list) else ["phaseHistory"]
    paths = (state.get("config") or {}).get("paths") or {}
    if state.get("config") and not paths:
        out.append("config.paths")
    return out + [f"config.paths.{k}" for k in ("projectRoot", "wikiRoot", "cacheRoot") if paths and not paths.get(k)]


def at_path(document: dict, path: str) -> object:
    """The value at a dotted path, none if it is not there."""
    for part in path.split("."):
        document = document.get(part) if isinstance(document, dict) else None
    return document


def with_path(document: dict, path: str, value: object) -> dict:
    """The document with a value at a dotted path; what is no document on the way is replaced."""
    head, _, rest = path.partition(".")
    inner = document.get(head)
    return {**document, head: with_path(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def release(lock: str) -> None:
    for name in (f"{lock}/pid",):
        if os.path.exists(name):
            os.remove(name)
    if os.path.isdir(lock):
        os.rmdir(lock)
