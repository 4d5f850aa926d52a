"""Plans of folders: roles, subtasks of bounded size, small groups merged across folders.

Input rows are files: folder, path, priority, tokens, n_dep, role, is_barrel.  Files of a folder are
taken by priority, most dependents, path.  Sizes come from the tokens of all folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.code import is_entry_stem, split_thresholds
from weftline.functions.paths import chapter_path, subtask_id
from weftline.operators.graph import durable
from weftline.operators.runs import next_fit_rows

# Roles in the order in which a folder's subtasks are numbered.
ROLES = ("entry", "ui-components", "business-components", "hooks", "utils", "types", "other")
FOLDER_LEVELS = ("high", "medium", "low")


def place(names: tuple[str, ...], c: Column) -> Column:
    """The place of a value in a fixed order, those unknown last."""
    out = F.lit(len(names))
    for k, n in reversed(list(enumerate(names))):
        out = F.when(c == n, k).otherwise(out)
    return out


def limits(files: DataFrame) -> dict[str, int]:
    """The thresholds of a project: one row on the driver."""
    total = files.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    return total.select(*[c.alias(k) for k, c in split_thresholds(F.col("t")).items()]).first().asDict()


def grouped(files: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """Logic files with the role they count for, ``moved`` (entry files behind those of the next role),
    role_tokens and should_split.

    Entry files that only re-export join the folder's next role, if there is one.
    """
    whole = files.groupBy("folder").agg(F.sum("tokens").alias("folder_tokens"))
    logic = files.filter(~F.col("priority").isin("P3", "P4")).withColumn("ro", place(ROLES, F.col("role")))
    folder = logic.groupBy("folder").agg(F.bool_and(F.when(F.col("ro") == 0, F.col("is_barrel"))).alias("idle"), F.min(F.when(F.col("ro") > 0, F.col("ro"))).alias("next"))
    rows = logic.join(folder, "folder").join(whole, "folder")
    moved = (F.col("ro") == 0) & F.coalesce(F.col("idle"), F.lit(False)) & F.col("next").isNotNull()
    rows = rows.withColumns({"moved": moved.cast("int"), "ro": F.when(moved, F.col("next")).otherwise(F.col("ro"))})
    rows = rows.withColumn("role", F.element_at(F.array(*map(F.lit, ROLES)), F.col("ro") + 1))
    sums = rows.groupBy("folder", "ro").agg(F.sum("tokens").alias("role_tokens"))
    rows = rows.join(sums, ["folder", "ro"]).withColumn("should_split", F.col("folder_tokens") > bounds["split"])
    small = (F.col("role_tokens") < bounds["merge_min"]) & F.col("should_split")
    return rows.select("folder", "path", "priority", "tokens", "n_dep", "role", "ro", "moved", "role_tokens", "should_split", small.alias("small"))


def _cross(small: DataFrame) -> DataFrame:
    """Of each role: the folders and tokens of its small groups."""
    return small.groupBy("role", "ro").agg(F.sum("tokens").alias("tokens"), F.count_distinct("folder").alias("n_folders"), F.count(F.lit(1)).alias("n_files"), F.min("folder").alias("folder"))


def members(files: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """(folder, path, tokens, priority, role, task_no, id, chapter, merge): the subtask of every planned file.

    Roles larger than ``split`` are cut by next fit at ``no_split``; a number counts the subtasks of
    a folder through its roles.  Small groups of a split folder are kept for merges across folders;
    those whose role is small in that folder alone return to its last subtask (``merge`` names it);
    what is small in several folders and too little altogether is in ``dropped``.
    """
    bounds = bounds or limits(files)
    rows = durable(grouped(files, bounds))  # read for the large, the rest and the small groups
    small = rows.filter("small")
    whole = rows.filter(~F.col("small"))
    order = ["moved", "priority", "down", "path"]
    large = whole.filter(F.col("role_tokens") > bounds["split"]).withColumn("down", -F.col("n_dep"))
    cut = next_fit_rows(large, ["folder", "ro"], order, "tokens", bounds["no_split"]).drop("down").withColumn("cut", F.lit(True))
    rest = whole.filter(F.col("role_tokens") <= bounds["split"]).withColumns({"chunk": F.lit(0).cast("long"), "cut": F.lit(False)})
    rows = cut.unionByName(rest)
    number = F.row_number().over(Window.partitionBy("folder").orderBy("ro", "chunk"))  # subtasks, not files
    tasks = rows.select("folder", "ro", "role", "chunk", "cut").distinct().withColumn("task_no", number)
    tasks = tasks.withColumn("id", F.when(F.col("cut"), subtask_id(F.col("folder"), F.col("role"), F.col("task_no"))).otherwise(subtask_id(F.col("folder"), F.col("role"), F.lit(1))))
    tasks = tasks.withColumn("chapter", chapter_path(F.col("folder"), F.col("role"), F.col("task_no")))
    own = rows.join(tasks.drop("role", "cut"), ["folder", "ro", "chunk"]).select("folder", "path", "tokens", "priority", "role", "task_no", "id", "chapter", F.lit(None).cast("string").alias("merge"))
    sole = _cross(small).filter("n_folders = 1").select("folder", "role")
    last = tasks.groupBy("folder").agg(F.max_by(F.struct("role", "task_no", "id", "chapter"), "task_no").alias("t"))
    back = small.join(sole, ["folder", "role"]).join(last, "folder").select("folder", "path", "tokens", "priority", "t.role", "t.task_no", "t.id", "t.chapter", F.concat(F.lit("cross-"), "role").alias("merge"))
    return own.unionByName(back)


def subtasks(files: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """(folder, role, task_no, id, chapter, tokens, n_files, priority, merge_with): one row a subtask.

    The priority is that of the files before others return; the last role that returns is ``merge_with``.
    """
    rows = members(files, bounds)
    out = rows.groupBy("folder", "role", "task_no", "id", "chapter").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_files"), F.when(F.bool_or(F.col("merge").isNull() & (F.col("priority") == "P0")), "P0").otherwise("P1").alias("priority"),
        F.max_by("merge", place(tuple(f"cross-{r}" for r in ROLES), F.col("merge")) + F.when(F.col("merge").isNull(), -len(ROLES) - 1).otherwise(0)).alias("merge_with"),
    )
    return out


def cross_merges(files: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """(id, role, n_folders, n_files, tokens, chapter): roles small in several folders, together large enough."""
    bounds = bounds or limits(files)
    got = _cross(grouped(files, bounds).filter("small")).filter((F.col("n_folders") >= 2) & (F.col("tokens") >= bounds["merge_min"]))
    name = F.concat(F.lit("cross-"), "role")
    return got.select(name.alias("id"), "role", "n_folders", "n_files", "tokens", F.concat(F.lit("appendix/"), name, F.lit(".md")).alias("chapter"))


def merge_members(files: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """(id, folder, path) of the merges across folders."""
    bounds = bounds or limits(files)
    small = grouped(files, bounds).filter("small").withColumn("id", F.concat(F.lit("cross-"), "role"))
    return small.join(cross_merges(files, bounds).select("id"), "id", "left_semi").select("id", "folder", "path")


def dropped(files: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """(folder, path, role) of small groups in several folders that stay below the least size together."""
    bounds = bounds or limits(files)
    small = grouped(files, bounds).filter("small")
    lost = _cross(small).filter((F.col("n_folders") >= 2) & (F.col("tokens") < bounds["merge_min"])).select("role")
    return small.join(lost, "role", "left_semi").select("folder", "path", "role")


def folders(files: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """(folder, n_files, n_logic, n_style, tokens, should_split, n_subtasks, priority), one row a folder."""
    bounds = bounds or limits(files)
    prio = F.col("priority")
    out = files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(~prio.isin("P3", "P4")).alias("n_logic"), F.count_if(prio == "P4").alias("n_style"), F.sum("tokens").alias("tokens"),
        F.when(F.bool_or(is_entry_stem(F.col("path"))), "high").otherwise("medium").alias("priority"),
    )
    n = subtasks(files, bounds).groupBy("folder").agg(F.count(F.lit(1)).alias("n_subtasks"))
    return out.join(n, "folder", "left").withColumns({"should_split": F.col("tokens") > bounds["split"], "n_subtasks": F.coalesce("n_subtasks", F.lit(0))})


def in_order(folder_rows: DataFrame) -> DataFrame:
    """Folders by level, then most files (ties by name)."""
    return folder_rows.orderBy(place(FOLDER_LEVELS, F.col("priority")), F.desc("n_files"), "folder")


def widened(affected: DataFrame, merges: DataFrame) -> DataFrame:
    """(folder): affected folders, and all of a merge that shares one with them.

    affected: folder; merges: id, folder, in the order of ids; a merge sees what merges before it
    added, once.  Merges number as many as roles, so the loop is short.
    """
    out = affected.select("folder").distinct()
    for (name,) in sorted(merges.select("id").distinct().collect()):
        part = merges.filter(F.col("id") == name).select("folder").distinct()
        if not part.join(out, "folder", "left_semi").isEmpty():
            out = out.unionAll(part).distinct()
    return out


def reset_by_folder(tasks: DataFrame, plan: DataFrame, affected: DataFrame, merges: DataFrame) -> DataFrame:
    """Tasks (id, folder, status) of affected folders are pending again, unless in progress.

    plan: folder, path (of the subtasks); affected: path.
    """
    hit = plan.join(affected.select("path").distinct(), "path", "left_semi").select("folder")
    wide = widened(hit, merges).withColumn("_a", F.lit(True))
    again = F.col("_a").isNotNull() & (F.col("status") != "in_progress")
    return tasks.join(wide, "folder", "left").withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).drop("_a")
