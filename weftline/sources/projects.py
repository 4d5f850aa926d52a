"""Projects: what package files tell, packages of a repository, scans as a whole, pattern files, volumes."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import ancestors, basename
from weftline.sources.readers import frontmatter, listed, source_files

# Packages that name a framework or a build tool, in the order in which they are asked for.
FRAMEWORKS = (("next", "next"), ("react", "react"), ("nuxt", "nuxt"), ("vue", "vue"), ("@angular/core", "angular"), ("@sveltejs/kit", "sveltekit"), ("svelte", "svelte"), ("@remix-run/react", "remix"), ("@remix-run/node", "remix"), ("astro", "astro"), ("solid-js", "solid"), ("@solidjs/router", "solid"))
BUILD_TOOLS = ("vite", "webpack", "rollup", "esbuild")
LOCK_FILES = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"))
JSX_PACKAGES = ("react", "vue", "@vue/compiler-sfc", "@babel/preset-react")
VOLUMES = ("wiki", "issue", "experience")
PACKAGE_FOLDERS = ("packages", "apps", "libs", "modules")


def _has(deps: Column, name: str) -> Column:
    """A package is there if its version is not empty."""
    return F.coalesce(deps[name], F.lit("")) != ""


def stack(packages: DataFrame, files: DataFrame) -> DataFrame:
    """packages: project, dependencies, dev_dependencies (maps); files: project, path (of the project's root).

    (project, framework, build_tool, package_manager, language, has_jsx, has_typescript): the first
    rule that holds.  TypeScript: a package of it, its settings, or such files two folders deep.
    """
    p = F.col("path")
    typed = p.rlike(r"^([^/]+/)?[^/]+\.tsx?$") & ~p.rlike(r"^(node_modules|dist|build)/")
    seen = files.groupBy("project").agg(*[F.bool_or(p == f).alias(f"_l{k}") for k, (f, _) in enumerate(LOCK_FILES)], F.bool_or((p == "tsconfig.json") | typed).alias("_ts"))
    rows = packages.join(seen, "project", "left")
    none = F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(F.coalesce("dependencies", none), lambda k, _: ~F.map_contains_key(F.coalesce("dev_dependencies", none), k)), F.coalesce("dev_dependencies", none))
    rows = rows.withColumn("_all", both)
    dev = F.coalesce(F.col("dev_dependencies"), none)

    def first(of: Column, names: tuple[tuple[str, str], ...], other: str) -> Column:
        out = F.lit(other)
        for package, name in reversed(names):
            out = F.when(_has(of, package), name).otherwise(out)
        return out

    manager = F.lit("npm")
    for k, (_, name) in reversed(list(enumerate(LOCK_FILES))):
        manager = F.when(F.col(f"_l{k}"), name).otherwise(manager)
    ts = _has(F.coalesce(F.col("dependencies"), none), "typescript") | _has(dev, "typescript") | F.coalesce("_ts", F.lit(False))
    jsx = F.lit(False)
    for name in JSX_PACKAGES:
        jsx = jsx | _has(F.col("_all"), name)
    return rows.select(
        "project", first(F.col("_all"), FRAMEWORKS, "node").alias("framework"), first(dev, tuple((b, b) for b in BUILD_TOOLS), "unknown").alias("build_tool"), manager.alias("package_manager"),
        F.when(ts, "typescript").otherwise("javascript").alias("language"), jsx.alias("has_jsx"), ts.alias("has_typescript"),
    )


def package_maps(files: DataFrame) -> DataFrame:
    """files: project, content (of package.json).  (project, name, dependencies, dev_dependencies)."""
    parsed = F.from_json(F.col("content").cast("string"), "name string, dependencies map<string,string>, devDependencies map<string,string>")
    return files.select("project", parsed.alias("j")).select("project", "j.name", "j.dependencies", F.col("j.devDependencies").alias("dev_dependencies"))


def project_figures(files: DataFrame) -> DataFrame:
    """(n_files, n_folders): source files, and distinct folders above them."""
    rows = source_files(files).select("path", F.explode_outer(ancestors(F.col("path"))).alias("folder"))
    return rows.agg(F.count_distinct("path").alias("n_files"), F.count_distinct("folder").alias("n_folders"))


def packages(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(package, name, n_files) of the source folders of a repository of several packages.

    names: package, name; without one a package has its folder's name.  n_files counts source files
    in a package's source folder and one folder below.
    """
    p = F.col("path")
    folder = F.regexp_extract(p, rf"^((?:{'|'.join(PACKAGE_FOLDERS)})/[^/.][^/]*)/src/", 1)
    inside = F.regexp_extract(p, r"^[^/]+/[^/]+/src/(.*)$", 1)
    counted = inside.rlike(r"^([^/.][^/]*/)?[^/]+\.(ts|tsx|js|jsx)$")
    rows = files.select(folder.alias("package"), counted.alias("c")).filter("package <> ''").groupBy("package").agg(F.count_if("c").alias("n_files"))
    if names is None:
        return rows.select("package", basename(F.col("package")).alias("name"), "n_files")
    return rows.join(names.groupBy("package").agg(F.max("name").alias("_n")), "package", "left").select("package", F.coalesce(F.nullif("_n", F.lit("")), basename(F.col("package"))).alias("name"), "n_files")


def pattern_source(raw: DataFrame) -> DataFrame:
    """raw: relpath, text.  (id, category, status, title, summary, tags, clusters, files, chapters, content) of pattern files."""
    f = frontmatter(F.col("text"), aliases=False)
    own = lambda k, other: F.coalesce(F.nullif(f[k], F.lit("")), other)
    folder = F.regexp_extract("relpath", r"^(.*)/[^/]*$", 1)
    return raw.select(
        own("id", F.regexp_replace(basename(F.col("relpath")), r"\.md$", "")).alias("id"), own("category", F.when(folder == "", ".").otherwise(folder)).alias("category"), own("status", F.lit("active")).alias("status"),
        own("title", F.lit("")).alias("title"), own("summary", F.lit("")).alias("summary"), listed(f["tags"]).alias("tags"), listed(f["source_clusters"]).alias("clusters"), listed(f["source_files"]).alias("files"),
        listed(f["wiki_chapters"]).alias("chapters"), F.trim(F.regexp_replace("text", r"^---\n[\s\S]*?\n---\n?", "")).alias("content"),
    )


def volumes(given: Column) -> Column:
    """The known names of a comma list, as they stand; all of them if there is none."""
    names = F.filter(F.transform(F.split(F.coalesce(given, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x.isin(*VOLUMES))
    return F.when(F.size(names) > 0, names).otherwise(F.array(*map(F.lit, VOLUMES)))


def parse_volumes(given: str | None) -> list[str]:
    """The same for one setting, with a warning about names that are not known."""
    parts = [p.strip().lower() for p in (given or "").split(",")] if (given or "").strip() else []
    if wrong := [p for p in parts if p not in VOLUMES]:
        warnings.warn(f"unknown volumes {wrong}; known are {list(VOLUMES)}", stacklevel=2)
    return [p for p in parts if p in VOLUMES] or list(VOLUMES)


def upward(start: str, name: str, exists: Callable[[str], bool] = os.path.exists) -> str | None:
    """The nearest folder at or above ``start`` that holds ``name``."""
    at = os.path.abspath(start)
    while True:
        if exists(os.path.join(at, name)):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
