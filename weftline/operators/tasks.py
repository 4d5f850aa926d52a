"""Packing, budgets, schedules and the state of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.code import token_budget
from weftline.operators.graph import durable, met, spread
from weftline.operators.runs import next_fit_rows, running

# Phases in their order, and the gap between ranges of issue numbers.
PHASES = ("INIT", "SCAN", "DEPENDENCY", "GEN", "ASSEMBLE", "VALIDATE")
ISSUE_GAP = 10
RETRIES = 3


def next_fit(df: DataFrame, key: list[str], order: list[str], weight: str, most: float) -> DataFrame:
    """key, chunk (from 0), n, total: a chunk ends when the next item would pass ``most``; keys may have any length."""
    rows = next_fit_rows(df.select(*key, *order, F.col(weight).alias("_weight")), key, order, "_weight", most)
    return rows.groupBy(*key, "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_weight").cast("double")).alias("total"))


def chunked(df: DataFrame, key: list[str], order: list[Column], least: int = 5, parts: int = 3) -> DataFrame:
    """Adds chunk: runs of max(least, ceil(n / parts)) rows in order."""
    w = Window.partitionBy(*key)
    size = F.greatest(F.lit(least), F.ceil(F.count(F.lit(1)).over(w) / parts))
    return df.withColumn("chunk", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size).cast("long"))


def ranked(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place (from 0) of a row in its key by ``order``, without bringing a key into one task.

    Rows are dealt into ranges of (key, order); the place is that within the range plus the rows of
    the key in ranges before it, which are one row for each range and key.
    """
    rows = durable(df.repartitionByRange(*key, *order).withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy(*key, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*key, "_p").orderBy(*order)) - 1
    return rows.withColumn("_r", within).join(offsets, [*key, "_p"]).withColumn(name, F.col("_r") + F.col("_off")).drop("_p", "_r", "_off")


def action(status: Column, seen_before: Column, resume: bool) -> Column:
    return (
        F.when(seen_before, "skip").when(status.isNull(), "run").when(status == "pending", "run" if resume else "skip")
        .when(status == "completed", "skip").when(status.isin("failed", "in_progress"), "retry").otherwise("skip")
    )


def schedule(tasks: DataFrame, known: DataFrame, resume: bool = True, issue_base: int = 1) -> DataFrame:
    """tasks: id, tokens, ord; known: id, status, ord (the last of an id counts).

    id, action, tokens, budget, ord, issue_from: a range of issue numbers for each task that runs.
    """
    last = known.groupBy("id").agg(F.max_by("status", "ord").alias("status"))
    rows = tasks.join(last, "id", "left")
    again = F.row_number().over(Window.partitionBy("id").orderBy("ord")) > 1
    rows = rows.withColumn("action", action(F.col("status"), again, resume)).withColumn("budget", token_budget(F.col("tokens")))
    rows = ranked(rows.withColumn("_go", F.col("action").isin("run", "retry")), ["_go"], ["ord"], "_rank")
    return rows.select("id", "action", "tokens", "budget", "ord", F.when(F.col("_go"), F.lit(issue_base) + ISSUE_GAP * F.col("_rank")).alias("issue_from"))


def action_order(a: Column) -> Column:
    return F.when(a == "retry", 0).when(a == "run", 1).otherwise(2)


def batch(rows: DataFrame, count: int, most_tokens: int, order: list[str], weight: str = "tokens") -> DataFrame:
    """The first ``count`` rows, then the longest beginning of them within ``most_tokens``.

    Nothing is taken if the first row is too large by itself; the limit comes first, so that the
    running sum is over ``count`` rows.
    """
    some = rows.orderBy(*order).limit(count)
    total = F.sum(weight).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("running", total).filter(F.col("running") <= most_tokens)


def retried(tasks: DataFrame, failed: DataFrame) -> DataFrame:
    """Completed tasks that failed verification are pending again, or failed after ``RETRIES`` tries."""
    rows = tasks.join(failed.select("id").distinct().withColumn("_f", F.lit(True)), "id", "left")
    hit = F.col("_f").isNotNull() & (F.col("status") == "completed")
    spent = F.col("retry_count") >= RETRIES
    return rows.withColumns({  # both from the status before
        "status": F.when(hit & spent, "failed").when(hit, "pending").otherwise(F.col("status")),
        "retry_count": F.when(hit & ~spent, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
    }).drop("_f")


def upsert_new(known: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Known tasks and those scheduled that are not known yet, as pending."""
    new = scheduled.join(known, "id", "left_anti").dropDuplicates(["id"]).select("id", F.lit("pending").alias("status"))
    return known.select("id", "status").unionByName(new)


def synced(tasks: DataFrame, found: DataFrame, orphaned: DataFrame | None = None) -> DataFrame:
    """tasks: id, status, chapter; found: id, found (``book.chapter_tasks``); orphaned: chapter, of pages that name
    issues without a file.

    Open tasks whose output is there are completed and know its chapter; with ``orphaned`` (strict)
    those whose chapter is listed stay, and ``blocked`` says so.  What is found meets the listed chapters
    before the tasks, of which those without an output have no chapter to be dealt by.
    """
    n, shut = tasks.count(), F.lit(False)
    there = found.filter("found is not null").select("id", "found")
    if orphaned is not None:
        listed = spread(orphaned.select(F.col("chapter").alias("found")), "found", count=n).distinct().withColumn("_o", F.lit(True))
        there = spread(there, "found", count=n).join(met(listed), "found", "left")
        shut = F.col("_o").isNotNull()
    rows = spread(tasks, "id", count=n).join(met(spread(there, "id", count=n)), "id", "left")
    open_ = F.col("found").isNotNull() & ~F.col("status").isin("completed", "failed")
    rows = rows.withColumns({"status": F.when(open_ & ~shut, "completed").otherwise(F.col("status")), "chapter": F.when(open_ & ~shut, F.coalesce(F.nullif("chapter", F.lit("")), "found")).otherwise(F.col("chapter")), "blocked": open_ & shut})
    return rows.drop("found", "_o")


def normal_status(raw: Column) -> Column:
    """A state of a task; what is not known is pending."""
    return F.when(raw.isin("completed", "in_progress", "failed"), raw).otherwise("pending")


def status_order(s: Column) -> Column:
    return F.when(s == "failed", 0).when(s == "in_progress", 1).when(s == "pending", 2).otherwise(3)


def status_counts(tasks: DataFrame, key: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    tasks = tasks.withColumn("status", normal_status(F.col("status")))
    cols = {s: F.count_if(F.col("status") == s) for s in ("completed", "in_progress", "pending", "failed")}
    out = tasks.groupBy(*key).agg(n.alias("total"), *[c.alias(s) for s, c in cols.items()])
    return out.withColumn("percent", F.round(100 * F.col("completed") / F.col("total")).cast("long")).withColumn(
        "status", F.when(F.col("failed") > 0, "failed").when(F.col("in_progress") > 0, "in_progress").when(F.col("pending") > 0, "pending").otherwise("completed")
    )


def reset_by_file(tasks: DataFrame, file_tasks: DataFrame, affected: DataFrame) -> DataFrame:
    """tasks: id, status; file_tasks: path, task; affected: path.  Tasks with an affected file are pending again,
    unless in progress."""
    hit = file_tasks.join(affected.select("path").distinct(), "path", "left_semi").select(F.col("task").alias("id")).distinct().withColumn("_a", F.lit(True))
    again = F.col("_a").isNotNull() & (F.col("status") != "in_progress")
    return tasks.join(hit, "id", "left").withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).drop("_a")


def file_tasks(clusters: DataFrame | None, subtasks: DataFrame | None) -> tuple[DataFrame, str]:
    """(path, task) of clusters (cluster, path) if there are any, else of subtasks (id, path), and which; neither is an error."""
    if clusters is not None and not clusters.isEmpty():
        return clusters.select("path", F.col("cluster").alias("task")).distinct(), "clusters"
    if subtasks is None:
        raise ValueError("neither clusters nor subtasks are given")
    return subtasks.select("path", F.col("id").alias("task")).distinct(), "folders"


def file_task_index(cluster_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, tasks) and (task, files), sorted, each once."""
    rows = cluster_files.select("path", "task").distinct()
    return (
        rows.groupBy("path").agg(F.array_sort(F.collect_list("task")).alias("tasks")),
        rows.groupBy("task").agg(F.array_sort(F.collect_list("path")).alias("files")),
    )


def phase_range(start: str | None, target: str | None) -> list[str]:
    """Phases from the start to the target, in their order: nothing without either, up to the last one for the target
    DONE (or none), which always ends with assembly and validation."""
    if not start and not target:
        return []
    start, target = start or PHASES[0], target or "DONE"
    a, b = (PHASES.index(x) if x in PHASES else len(PHASES) for x in (start, target))
    return [x for k, x in enumerate(PHASES) if a <= k <= b or (target == "DONE" and x in ("ASSEMBLE", "VALIDATE"))]


def transitions(events: DataFrame, most: int = RETRIES) -> DataFrame:
    """events: run, ord, phase, status, next (null: none).  Adds retries, current and last_success: a run's state after each
    event.

    Each entry into FEEDBACK is a retry; more than ``most`` end the run.  The current phase is else the
    last one entered, the last success the last phase completed.  Runs may be of any length.
    """
    entered, ok = F.when(F.col("next").isNotNull(), F.struct("ord", "next")), F.when(F.col("status") == "completed", F.struct("ord", "phase"))
    again = (F.coalesce(F.col("next"), F.lit("")) == "FEEDBACK").cast("long")
    rows = running(events, ["run"], ["ord"], {"_r": ("sum", again), "_n": ("max", entered), "_s": ("max", ok)})
    rows = rows.withColumn("retries", F.coalesce("_r", F.lit(0)) + again)
    return rows.select(*events.columns, "retries", F.when(F.col("retries") > most, "DONE").otherwise(F.coalesce(F.col("next"), F.col("_n.next"))).alias("current"), F.coalesce(F.when(F.col("status") == "completed", F.col("phase")), F.col("_s.phase")).alias("last_success"))


def phase_records(events: DataFrame) -> DataFrame:
    """events: run, ord, phase, status, next, at.  (run, phase, status, started, ended): a run's record of each phase, after
    all events: the status last told, or in_progress where it was entered later."""
    told = events.select("run", "ord", "phase", "status", F.lit(0).alias("k"), "at")
    entered = events.filter("next is not null").select("run", "ord", F.col("next").alias("phase"), F.lit("in_progress").alias("status"), F.lit(1).alias("k"), "at")
    rows = told.unionByName(entered).groupBy("run", "phase")
    last = F.struct("ord", "k")
    return rows.agg(F.max_by("status", last).alias("status"), F.min_by("at", last).alias("started"), F.max_by("at", F.when(F.col("k") == 0, F.col("ord"))).alias("ended"))


def append_feedback(log: list[tuple[str, str]], phase: str, message: str, window: int = 10) -> list[tuple[str, str]]:
    """The log of (phase, message) with the entry, unless one of the last ``window`` is of the phase and has the message's
    first line."""
    first = message.split("\n")[0].strip()
    return log if any(p == phase and first in m for p, m in log[-window:]) else [*log, (phase, message)]
