"""Path and identifier expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(p: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"^\./", "")


def relative(p: Column, root: str) -> Column:
    """Below ``root``; paths elsewhere stay as they are."""
    base = root.rstrip("/") + "/"
    return F.when(p.startswith(base), p.substr(F.lit(len(base) + 1), F.length(p))).otherwise(p)


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def dirname(p: Column) -> Column:
    d = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def extname(p: Column) -> Column:
    """With the dot; empty for none and for a name that begins with its only dot."""
    return F.regexp_extract(basename(p), r"^.+(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"(?<=.)\.[^.]*$", "")


def ancestors(p: Column) -> Column:
    """All directories above, the nearest last; empty for a bare name."""
    parts = F.split(p, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def common_directory(paths: Column) -> Column:
    """The longest directory that all paths of an array share, as a path; empty if none."""
    dirs = F.transform(paths, lambda p: F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))))
    first = F.element_at(dirs, 1)
    upto = F.filter(F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1))), lambda k: (k <= F.size(first)) & F.forall(dirs, lambda d: F.slice(d, 1, k) == F.slice(first, 1, k)))
    return F.coalesce(F.array_join(F.slice(first, 1, F.coalesce(F.array_max(upto), F.lit(0))), "/"), F.lit(""))


def path_id(p: Column) -> Column:
    """Letters, digits, - and _ only, lower case, "root" if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[^a-zA-Z0-9_-]", "_"), "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(F.lower(x), F.lit("")), F.lit("root"))


def role_id(r: Column) -> Column:
    x = F.lower(F.regexp_replace(F.regexp_replace(r, "[^a-zA-Z0-9_-]", "_"), "--+", "-"))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("default"))


def _suffix(n: Column) -> Column:
    return F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")


def subtask_id(folder: Column, role: Column, n: Column) -> Column:
    return F.concat(path_id(folder), F.lit("-"), role_id(role), _suffix(n))


def chapter_path(folder: Column, role: Column, n: Column) -> Column:
    return F.concat(F.lit("ch-"), path_id(folder), F.lit("/sec-"), role_id(role), _suffix(n), F.lit(".md"))


def node_id(p: Column) -> Column:
    """A path as the name of a node in a drawing: path_id in its own case, and empty if nothing is left."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[^a-zA-Z0-9_-]", "_"), "_+", "_"), "^_|_$", "")


def folder_key(p: Column) -> Column:
    return F.lower(node_id(p))


def slug(t: Column, n: int = 40) -> Column:
    """Letters, digits and - of a title, lower case; "pattern" if nothing is left."""
    x = F.lower(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}\s-]", ""), r"\s+", "-"))
    return F.coalesce(F.nullif(F.substring(x, 1, n), F.lit("")), F.lit("pattern"))


def padded(n: Column, width: int) -> Column:
    """A number with zeros in front up to ``width`` digits; longer ones stay whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), "0")


def short(p: Column, n: int = 40) -> Column:
    """At most ``n`` characters: the end behind three dots."""
    return F.when(F.length(p) > n, F.concat(F.lit("..."), F.substring(p, 3 - n, n - 3))).otherwise(p)


def yaml_text(t: Column) -> Column:
    """For use between double quotes."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t
