"""Ignore files of a tree: rules of every folder as a table, and the paths they leave out.

An entry (a folder or a file) is decided by the last rule that names it, of the deepest folder first;
a file goes if it or any folder above it is ignored, as nothing comes back from an ignored folder.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.paths import ancestors

NAME = ".gitignore"
RULE = "negated boolean, only_folders boolean, pattern string"


def rule(line: str) -> tuple[bool, bool, str] | None:
    """(is an exception, only for folders, pattern for a path below the rule's folder) of a line; none for others."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r"))
    if not line or line.startswith("#"):
        return None
    negated, body = line.startswith("!"), line.removeprefix("!")
    only_folders, body = body.endswith("/"), body.rstrip("/")
    if not body:
        return None
    anchored, body = "/" in body, body.removeprefix("/")
    parts = []
    for x in re.findall(r"(?:^|(?<=/))\*\*/|(?<=/)\*\*$|^\*\*$|\*+|\?|\[!?\]?[^\]]*\]|\\.|[^*?\[\\]+|.", body):
        if x == "**/":
            parts.append("(?:.*/)?")
        elif x == "**" and (body == "**" or body.endswith("/**")):
            parts.append(".+")
        elif x[0] == "*":
            parts.append("[^/]*")
        elif x == "?":
            parts.append("[^/]")
        elif x[0] == "[" and len(x) > 2:
            parts.append("(?!/)[" + ("^" if x[1] == "!" else "") + re.sub(r"([\\\[\]&^])", r"\\\1", x[1:-1].removeprefix("!")) + "]")
        else:
            parts.append(re.escape(x[1:] if x[0] == "\\" and len(x) == 2 else x))
    return negated, only_folders, ("" if anchored else "(?:.*/)?") + "".join(parts)


def rules(texts: DataFrame) -> DataFrame:
    """texts: folder ("" for the root), text.  (folder, depth, line, negated, only_folders, pattern)."""

    @F.pandas_udf(RULE)
    def parsed(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule(x) or (None, None, None) for x in lines], columns=["negated", "only_folders", "pattern"])

    lines = texts.select("folder", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return lines.withColumn("r", parsed("raw")).filter("r.pattern is not null").select("folder", depth.alias("depth"), "line", "r.*")


def _decided(entries: DataFrame, by_folder: DataFrame) -> DataFrame:
    """entries: path, is_folder.  (path, ignored) of those that a rule names."""
    above = F.array_append(ancestors(F.col("path")), F.lit(""))
    each = entries.withColumn("folder", F.explode(above)).join(by_folder, "folder")
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    hits = F.filter("rules", lambda r: (F.col("is_folder") | ~r["only_folders"]) & F.regexp_like(below, F.concat(F.lit("^"), r["pattern"], F.lit("$"))))
    last = F.try_element_at(hits, F.lit(-1))
    return each.select("path", "depth", (~last["negated"]).alias("ignored")).filter("ignored is not null").groupBy("path").agg(F.max_by("ignored", "depth").alias("ignored"))


def kept(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files with a path, those out that the rules ignore.  Rules of a folder meet each entry below it once, as one
    list in the order of lines."""
    by_folder = rules.groupBy("folder", "depth").agg(F.array_sort(F.collect_list(F.struct("line", "negated", "only_folders", "pattern"))).alias("rules"))
    paths = files.select("path").distinct()
    folders = paths.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    entries = paths.withColumn("is_folder", F.lit(False)).unionByName(folders.withColumn("is_folder", F.lit(True)))
    bad = _decided(entries, by_folder).filter("ignored").select(F.col("path").alias("_bad"))
    gone = paths.select("path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("_bad")).join(bad, "_bad").select("path").distinct()
    return files.join(gone, "path", "left_anti")


def read(spark: SparkSession, root: str) -> DataFrame:
    """(folder, text) of the ignore files below a root, which a scan itself would pass over as hidden: their names come
    from the file system's listing, their texts are small."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, found = fs.makeQualified(base).toString().rstrip("/"), []
    listing = fs.listFiles(base, True)
    while listing.hasNext():
        path = listing.next().getPath()
        if path.getName() == NAME:
            stream = fs.open(path)
            try:
                found.append((path.getParent().toString()[len(top) :].strip("/"), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return spark.createDataFrame(found, "folder string, text string")
