"""Reports as tables of lines: each line has its place in the order of the report, so that reports of any size are
written by the tasks; only ``text``, ``table`` and the index of reports bring what they show to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import padded
from weftline.operators.tasks import ranked


def table(df: DataFrame, columns: list[str] | None = None, limit: int = 1000) -> str:
    columns = columns or df.columns
    rows = df.select(*columns).limit(limit).collect()
    cell = lambda x: ", ".join(map(str, x)) if isinstance(x, list) else "—" if x is None else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]])


def progress_bar(done: int, total: int, width: int = 20) -> str:
    n = round(width * done / total) if total else 0
    return "█" * n + "░" * (width - n)


def short(name: str, n: int = 40) -> str:
    return name if len(name) <= n else "..." + name[3 - n :]


def percent(x: int, total: int) -> str:
    """With one place behind the point, halves up; a dash of nothing."""
    return "—" if not total else f"{int(x * 1000 / total + 0.5) / 10:g}%"


def report(title: str, sections: list[tuple[str, str]], front: dict[str, object] | None = None) -> str:
    head = ["\n".join(["---", *[f"{k}: {v}" for k, v in front.items()], "---"])] if front else []
    return "\n\n".join([*head, f"# {title}", *[f"## {h}\n\n{body}" for h, body in sections]]) + "\n"


SEVERITY_MARKS = {"critical": "⛔", "high": "🔴", "medium": "🟡", "low": "🟢"}
STATUS_MARKS = {"completed": "✅", "in_progress": "🔄", "pending": "⏳", "failed": "❌"}
PATTERN_MARKS = {"stale": " ⚠️", "orphaned": " 🗑️", "deprecated": " ❌"}


#: The order of a report's lines: section, group, kind in a group, place, name, line of a row.
ORDER = ("s", "a", "g", "p", "b", "n")


def _some(df: DataFrame, s: int, lines: list, a: Column | str = "", g: int = 0, p: Column | int = 0, b: Column | str = "") -> DataFrame:
    """Lines of each row of a table, with their place in the report; null lines are left out."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    place = p if isinstance(p, Column) else F.lit(p)
    rows = df.select(F.lit(s).alias("s"), text(a).alias("a"), F.lit(g).alias("g"), place.cast("long").alias("p"), text(b).alias("b"), F.posexplode(F.array(*map(text, lines))).alias("n", "line"))
    return rows.filter("line is not null")


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _front(figures: DataFrame, title: str, values: dict[str, Column]) -> DataFrame:
    """The head of a report, from a table of one row."""
    return _some(figures, 0, ["---", *[said(f"{k}: ", v) for k, v in values.items()], "---", "", f"# {title}"])


def said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])


def _mark(marks: dict[str, str], c: Column, other: str) -> Column:
    out = F.lit(other)
    for k, m in marks.items():
        out = F.when(c == k, m).otherwise(out)
    return out


def _place(names: dict | tuple, c: Column) -> Column:
    out = F.lit(99)
    for k, x in enumerate(names):
        out = F.when(c == x, k).otherwise(out)
    return out


def numbered(lines: DataFrame) -> DataFrame:
    """(place, line): lines in the order of the report, from 0."""
    return ranked(lines, [], list(ORDER), "place").select("place", "line")


def write(lines: DataFrame, path: str) -> None:
    """The report as text: lines are dealt into ranges and written by the tasks, files in their order."""
    lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("line").write.mode("overwrite").text(path)


def text(lines: DataFrame) -> str:
    """A small report as one text, for showing."""
    return "\n".join(r.line for r in lines.orderBy(*ORDER).collect()) + "\n"


def book(pages: DataFrame, labels: DataFrame, figures: DataFrame, chapters: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Lines of the book.  pages: chapter, section, title, n_files; labels: chapter, label; figures: one row
    (``book.book_figures``); chapters: chapter, n_pages, n_files, n_issues; links: chapter, section, id, severity of issues."""
    c, sec = F.col("chapter"), F.col("section")
    label = pages.select("chapter").distinct().join(labels, "chapter", "left").join(chapters, "chapter", "left").withColumn("label", F.coalesce("label", "chapter"))
    url = said("(volume-1-code/", c, "/", sec, ")")
    about = said("- **", F.col("n_pages"), "** pages, **", F.col("n_files"), "** files", F.when(F.col("n_issues") > 0, said(", **", F.col("n_issues"), "** issues")).otherwise(""))
    cells, rows = ["page", "title", "files"], pages
    tail = F.lit("")
    if links is not None:
        cells.append("issues")
        shown = F.transform(F.array_sort(F.collect_list(F.struct("id", "severity"))), lambda x: said(_mark(SEVERITY_MARKS, x["severity"], "⚪"), " [[", x["id"], "]]"))
        rows = pages.join(links.groupBy("chapter", "section").agg(F.array_join(shown, " ").alias("shown")), ["chapter", "section"], "left")  # of a page
        tail = said(" ", F.coalesce("shown", F.lit("-")), " |")
    row = said("| [", sec, "]", url, " | ", F.coalesce(F.nullif("title", F.lit("")), F.lit("-")), " | ", F.col("n_files"), " |", tail)
    return _all(
        _front(figures, "Book", {"chapters": F.col("n_chapters"), "pages": F.col("n_pages"), "symbols": F.col("n_symbols")}),
        _some(figures, 1, ["", "## Contents"]), _some(label, 2, ["", said("### ", F.col("label")), ""], c),
        _some(pages, 2, [said("- [", F.coalesce(F.nullif("title", F.lit("")), sec), "]", url)], c, 1, 0, sec), _some(figures, 3, ["", "## Chapters"]),
        _some(label, 4, ["", said("### ", F.col("label")), "", about, "", "| " + " | ".join(cells) + " |", "|" + "---|" * len(cells)], c), _some(rows, 4, [row], c, 1, 0, sec),
    )


KINDS = ("component", "hook", "function", "symbol")


def glossary(symbols: DataFrame) -> DataFrame:
    """Lines of the glossary.  symbols: name, type, relpath: by type in a fixed order, names in order."""
    t = F.col("type")
    kinds = symbols.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("k", said(F.lpad(_place(KINDS, t).cast("string"), 2, "0"), t))
    rows = symbols.withColumn("k", said(F.lpad(_place(KINDS, t).cast("string"), 2, "0"), t))
    total = symbols.agg(F.count(F.lit(1)).alias("n"))
    page = F.regexp_replace("relpath", r"\.md$", "")
    return _all(
        _front(total, "Glossary", {"total_symbols": F.col("n")}), _some(total, 1, ["", "## Types", "", "| type | n |", "|---|---|"]), _some(kinds, 2, [said("| ", t, " | ", F.col("n"), " |")], F.col("k")),
        _some(kinds, 3, ["", said("## ", t), "", "| name | page |", "|---|---|"], F.col("k")), _some(rows, 3, [said("| `", F.col("name"), "` | [[", page, "]] |")], F.col("k"), 1, 0, said(F.col("name"), "\x01", F.col("relpath"))),
    )


DIMENSIONS = ("status", "severity", "type", "confidence")


def issue_dashboard(counts: DataFrame, pending: DataFrame) -> DataFrame:
    """Lines of the dashboard.  counts: dimension, value, n, pending; pending: id, severity, detected_at: most severe
    first, latest first."""
    d, v = F.col("dimension"), F.col("value")
    total = counts.filter("dimension = 'status'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    heads = total.select("n", F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension"))
    s = said(_place(DIMENSIONS, d))
    listed = ranked(pending.select("id", "severity", "detected_at").withColumn("_s", _place(SEVERITY_MARKS, F.col("severity"))), ["_s"], ["detected_at", "id"], "_up")
    same = listed.groupBy("_s", "detected_at").agg(F.min("_up").alias("_first"), F.max("_up").alias("_last"))  # latest first, ids of a time in order
    listed = listed.join(same, ["_s", "detected_at"]).withColumn("p", F.col("_up") - F.col("_first") - F.col("_last"))
    return _all(
        _front(total, "Issues", {"total": F.col("n")}), _some(heads, 1, ["", said("## ", d), "", "| value | n | pending |", "|---|---|---|"], s),
        _some(counts.filter(d.isin(*DIMENSIONS)), 1, [said("| ", F.coalesce(v, F.lit("None")), " | ", F.col("n"), " | ", F.col("pending"), " |")], s, 1, F.when(v.isNull(), 0).otherwise(1), F.coalesce(v, F.lit(""))),
        _some(total, 1, [said("| **total** | **", F.col("n"), "** | |")], "0", 2), _some(total, 2, ["", "## Pending", ""]),
        _some(listed, 3, [said("- ", _mark(SEVERITY_MARKS, F.col("severity"), "⚪"), " [[", F.col("id"), "]] ", F.col("detected_at"))], F.lpad(F.col("_s").cast("string"), 2, "0"), 0, F.col("p"), ""),
    )


def file_issues(index: DataFrame, by_severity: DataFrame) -> DataFrame:
    """Lines of the issues of each file.  index: path, id, type, severity, title; by_severity: severity, n."""
    sev, path = F.col("severity"), F.col("path")
    one = index.agg(F.count_distinct("path").alias("files")).join(by_severity.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issues")))  # one row each
    row = said("- ", _mark(SEVERITY_MARKS, sev, "⚪"), " [[", F.col("id"), "]] — ", F.col("title"), " _( ", F.col("type"), " )_")
    return _all(
        _front(one, "Files and issues", {"issues": F.col("issues"), "files": F.col("files")}), _some(one, 1, ["", "## Severity", "", "| severity | n |", "|---|---|"]),
        _some(by_severity.filter(sev.isin(*SEVERITY_MARKS) & (F.col("n") > 0)), 2, [said("| ", _mark(SEVERITY_MARKS, sev, ""), " ", sev, " | ", F.col("n"), " |")], "", 0, _place(SEVERITY_MARKS, sev)),
        _some(one, 3, ["", "## Files"]), _some(index.select("path").distinct(), 4, ["", said("### `", path, "`"), ""], path), _some(ranked(index, ["path"], ["id"], "_place"), 4, [row], path, 1, F.col("_place")),
    )


def experience(patterns: DataFrame, counts: DataFrame, whole: bool = False) -> DataFrame:
    """Lines of the patterns.  patterns: id, category, status, title, summary, clusters; counts: ``registers.pattern_counts``.

    Candidates are counted, not shown; ``whole``: with the figures in front; without, nothing is said of nothing.
    """
    status, cat = F.col("status"), F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized"))
    n = lambda *names: F.count_if(status.isin(*names))
    one = patterns.agg(F.count_if(status != "candidate").alias("total_patterns"), n("active").alias("active"), n("stale").alias("stale"), n("orphaned", "deprecated").alias("orphaned"), n("candidate").alias("candidate"), F.count_distinct(cat).alias("categories"))
    some = one.filter("total_patterns > 0")
    shown = patterns.filter(status != "candidate").withColumn("category", cat)
    first = F.array_join(F.slice("clusters", 1, 3), ", ")
    origin = F.when(F.size("clusters") > 0, said(" | ", first, F.when(F.size("clusters") > 3, "...").otherwise(""))).otherwise("")
    text_ = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("title", F.lit("")), F.col("id"))
    row = said("- [", F.col("id"), "](volume-3-experience/", F.col("category"), "/", F.col("id"), ".md)", _mark(PATTERN_MARKS, status, ""), " — ", text_, origin)
    head = _front(one, "Experience", {c: F.col(c) for c in one.columns}) if whole else _some(some, 0, ["# Experience"])
    return _all(
        head, _some(some, 1, ["", "## Categories", "", "| category | active | stale | orphaned |", "| --- | --- | --- | --- |"]),
        _some(counts, 2, [said("| ", F.replace(F.col("category"), F.lit("|"), F.lit("\\|")), " | ", F.col("active"), " | ", F.col("stale"), " | ", F.col("orphaned"), " |")], F.col("category")),
        _some(shown.select("category").distinct(), 3, ["", said("## ", F.col("category")), ""], F.col("category")), _some(shown, 3, [row], F.col("category"), 1, 0, F.col("id")),
    )


def master_index(figures: dict[str, dict[str, object] | None]) -> str:
    """figures: for each of book, issues, experience what to say of it, none if it is not there; from tables, not
    from rendered text."""
    rows = [f"| [[{k}]] | {' / '.join(f'{v} {n}' for n, v in f.items() if v) or '✓'} |" for k, f in figures.items() if f is not None]
    missing = [f"- {k}: not built yet" for k, f in figures.items() if f is None]
    links = [f"- [[{k}]]" for k, f in figures.items() if f is not None]
    return report("Knowledge base", [("Overview", "\n".join(["| part | figures |", "|---|---|", *rows])), *([("Missing", "\n".join(missing))] if missing else []), ("Navigation", "\n".join(links))], {"type": "master_index"})


def progress(rows: DataFrame, phase: str = "GEN") -> DataFrame:
    """Lines of the progress.  rows: folder, n_files, tokens, total, completed, status and a count of each state
    (``tasks.status_counts``): by state, failed first."""
    st, states = F.col("status"), ("failed", "in_progress", "pending", "completed")
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", *STATUS_MARKS)])
    share = lambda x, y: F.when(y == 0, "—").otherwise(F.concat(F.regexp_replace((F.floor(x * 1000 / y + 0.5) / 10).cast("string"), r"\.0$", ""), F.lit("%")))
    bar = lambda x, y, n: F.when(y == 0, "░" * n).otherwise(F.concat(F.repeat(F.lit("█"), F.bround(n * x / y, 0).cast("int")), F.repeat(F.lit("░"), n - F.bround(n * x / y, 0).cast("int"))))
    name = F.col("folder").cast("string")
    name = F.when(F.length(name) <= 40, name).otherwise(F.concat(F.lit("..."), F.expr("right(cast(folder as string), 37)")))
    line = said("| `", name, "` | ", F.col("n_files"), " | ", F.format_number("tokens", 0), " | ", F.col("total"), " | ", F.col("completed"), " | ", _mark(STATUS_MARKS, st, ""), " ", bar(F.col("completed"), F.col("total"), 10), " |")
    kinds = rows.filter(st.isin(*states)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    each = [said("| ", f"{m} {k}", " | ", F.col(k), " | ", share(F.col(k), F.col("total")), " |") for k, m in STATUS_MARKS.items()]
    place = said(_place(states, st))
    return _all(
        _front(sums, "Progress", {"phase": F.lit(phase)}), _some(sums, 1, ["", "## Total", "", "| state | n | share |", "|---|---|---|", *each, "", said(bar(F.col("completed"), F.col("total"), 40), " ", share(F.col("completed"), F.col("total")))]),
        _some(kinds, 2, ["", said("## ", _mark(STATUS_MARKS, st, ""), " ", st, " (", F.col("n"), ")"), "", "| folder | files | tokens | tasks | done | state |", "|---|---|---|---|---|---|"], place),
        _some(ranked(rows.filter(st.isin(*states)), ["status"], ["folder"], "_place"), 2, [line], place, 1, F.col("_place")),
    )


def prompt(task: dict, files: list[str], meta: str = "", feedback: str = "") -> str:
    """A task for a writer: what to read, its budget, its range of issue numbers, and what is known of the files."""
    sections = [("Files", "\n".join(f"- `{f}`" for f in files)), ("Budget", f"{task['budget']:,} tokens")]
    if task.get("issue_from") is not None:
        sections.append(("Issue numbers", f"IS-{task['issue_from']:04d} to IS-{task['issue_from'] + 9:04d}"))
    sections += [("Output", task["chapter"])] if task.get("chapter") else []
    sections += [("Known of the files", meta)] if meta else []
    text = report(str(task["id"]), sections)
    return inject(text, feedback) if feedback else text


def prompts(schedule: DataFrame, files: DataFrame) -> DataFrame:
    """schedule: id, action, budget, issue_from, chapter; files: id, path.  (id, text) of the tasks that run, without
    bringing them to the driver; a task's files are bounded by its tokens."""
    listed = files.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n").alias("files"))
    number = lambda n: F.concat(F.lit("IS-"), padded(n, 4))
    parts = [
        F.concat(F.lit("# "), F.col("id").cast("string")), F.concat(F.lit("## Files\n\n"), F.coalesce("files", F.lit(""))), F.concat(F.lit("## Budget\n\n"), F.format_number("budget", 0), F.lit(" tokens")),
        F.concat(F.lit("## Issue numbers\n\n"), number(F.col("issue_from")), F.lit(" to "), number(F.col("issue_from") + 9)), F.concat(F.lit("## Output\n\n"), F.col("chapter")),
    ]
    return schedule.filter(F.col("action") != "skip").join(listed, "id", "left").select("id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("text"))


def kept_prompts(existing: DataFrame, schedule: DataFrame) -> DataFrame:
    """existing: name (of a prompt's file).  Names that stay: those of tasks that are not done."""
    done = schedule.filter("action = 'skip'").select(F.concat("id", F.lit(".md")).alias("name"))
    return existing.join(done, "name", "left_anti")


def inject(text: str, feedback: str, mark: str = "<!-- feedback -->") -> str:
    """The text with a feedback section at its end, replacing an earlier one."""
    return text.split(mark)[0].rstrip() + f"\n\n{mark}\n{feedback}\n"
