"""Expressions on source files: classes of files, token estimates, names found in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import basename, dirname, extname, stem

# Extensions scanned, directories left out, and patterns of file kinds.
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "vue", "svelte", "mjs", "cjs", "mts")
STYLE_EXTENSIONS = (".css", ".scss", ".less", ".sass", ".styl")
ASSET_DIRECTORY = r"(^|/)(assets|images|img|icons|fonts|static|media)/"
ENTRY = r"^(index|main|app|root)\.(ts|tsx|js|jsx)$"
TEST = r"\.test\.(ts|tsx|js|jsx)$|\.spec\.(ts|tsx|js|jsx)$|__tests__/"
STORY = r"\.stories\.(ts|tsx|js|jsx)$|\.story\.(ts|tsx|js|jsx)$"
NO_META = r"\.(test|spec|stories|story)\.(ts|tsx|js|jsx)$|/__tests__/"
LOOSE_JSX = r"<\w+[^>]*>|</\w+>|React\.createElement"
STRICT_JSX = r"<[A-Z]\w+\s*/?>|</[A-Z]\w+\s*>|<[a-z]+\s+(?:[^>]*/)?>"
HOOK_CALL = r"\buse[A-Z]\w+\s*\("
EXPORTS = (
    r"export\s+(?:const|function|let|var|class)\s+(\w+)",
    r"export\s+default\s+(?:function|class)\s+(\w+)",
    r"export\s*\{\s*(\w+)",
    r"export\s+default\s+(\w+)",
    r"export\s+(?:interface|type)\s+(\w+)",
    r"export\s+enum\s+(\w+)",
)
PROPS = (r"interface\s+(\w+Props)\b", r"type\s+(\w+Props)\s*=", r"<\s*(\w+Props)\s*>")
DIRECTIVES = ('"use client"', "'use client'", '"use server"', "'use server'")
ENTRY_STEMS = ("app", "main", "index")
#: Characters of a file that patterns look at; counts come from the whole text.
HEAD = 8192


def head(content: Column, n: int = HEAD) -> Column:
    return F.substring(content, 1, n)


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n")).cast("long")


def is_entry(p: Column) -> Column:
    return basename(p).rlike(ENTRY)


def is_test(p: Column) -> Column:
    return p.rlike(TEST)


def is_story(p: Column) -> Column:
    return p.rlike(STORY)


def is_style(p: Column) -> Column:
    return extname(p).isin(*STYLE_EXTENSIONS)


def is_styled_module(p: Column) -> Column:
    """A styling module by its name, not a test of one."""
    b = F.lower(basename(p))
    return (b.contains(".styled.") | b.contains(".styles.")) & ~b.contains(".spec.") & ~b.contains(".test.")


def is_business(p: Column) -> Column:
    d = F.lower(dirname(p))
    names = ("pages", "features", "modules")
    out = F.lit(False)
    for n in names:
        out = out | d.contains(f"/{n}/") | p.startswith(f"{n}/")
    return out


def is_entry_stem(p: Column) -> Column:
    return F.lower(stem(p)).isin(*ENTRY_STEMS)


def marks(content: Column) -> tuple[Column, Column]:
    """(markup, hooks) in the head of a file; a file without content has neither."""
    h = F.coalesce(head(content), F.lit(""))
    return h.rlike(LOOSE_JSX), h.rlike(HOOK_CALL)


def priority_of(p: Column, dependents: Column, jsx: Column, hook: Column) -> Column:
    """P0 to P4, the first rule that holds."""
    return (
        F.when(is_style(p), "P4").when(is_test(p) | is_story(p), "P3").when(is_entry(p) | (dependents >= 10), "P0")
        .when(jsx | hook | (dependents >= 5), "P1").otherwise("P2")
    )


def priority(p: Column, dependents: Column, content: Column) -> Column:
    return priority_of(p, dependents, *marks(content))


def reason_of(p: Column, prio: Column, dependents: Column, jsx: Column, hook: Column) -> Column:
    said = F.concat_ws(
        " + ",
        F.when(is_entry(p), "entry file (naming pattern)"),
        F.when(is_test(p), "test file"),
        F.when(is_story(p), "story file"),
        F.when(is_style(p), "pure style file"),
        F.when(dependents >= 10, F.concat(F.lit("highly depended ("), dependents.cast("string"), F.lit(")"))).when(dependents >= 5, F.concat(F.lit("depended ("), dependents.cast("string"), F.lit(")"))),
        F.when((prio == "P1") & jsx, "contains JSX"),
        F.when((prio == "P1") & hook, "contains hooks"),
    )
    return F.coalesce(F.nullif(said, F.lit("")), F.concat(F.lit("default ("), prio, F.lit(")")))


def reason(p: Column, prio: Column, dependents: Column, content: Column) -> Column:
    return reason_of(p, prio, dependents, *marks(content))


def estimated_tokens(p: Column, chars: Column, has_jsx: Column) -> Column:
    ext = extname(p)
    per = (
        F.when(basename(p).endswith(".d.ts"), 5.5).when(ext.isin(".tsx", ".jsx") & has_jsx, 3.8)
        .when(ext.isin(*STYLE_EXTENSIONS), 5.0).otherwise(4.5)
    )
    return F.greatest(F.lit(1), F.round(chars / per)).cast("long")


def role(p: Column, prio: Column) -> Column:
    b, d = F.lower(basename(p)), F.lower(dirname(p))
    holds = lambda c, *names: F.greatest(*[c.contains(n) for n in names]) if len(names) > 1 else c.contains(names[0])
    return (
        F.when(F.greatest(*[b.startswith(e) for e in ENTRY_STEMS]), "entry")
        .when(b.startswith("use") | holds(d, "hook"), "hooks")
        .when(holds(d, "type") | holds(b, ".d.ts", "interface", "enum"), "types")
        .when(holds(d, "components", "ui", "common"), "ui-components")
        .when(holds(d, "pages", "features", "modules"), "business-components")
        .when(holds(d, "util", "helpers", "lib"), "utils")
        .when(prio == "P0", "entry").when(prio == "P1", "business-components").otherwise("utils")
    )


def is_barrel(content: Column, limit: int = HEAD, stars: bool = True) -> Column:
    """Nothing but blank lines, comments, re-exports and directives; ``stars``: comment lines may begin with *."""

    def idle(line: Column) -> Column:
        t = F.trim(F.regexp_replace(line, r"[\t\r\f\x0B]", " "))
        comment = (t == "") | t.startswith("//") | t.startswith("/*") | (t.startswith("*") if stars else F.lit(False))
        again = t.startswith("export * from") | (t.rlike(r"^export\s*(?:type|interface)?\s*\{") & t.contains("} from"))
        return comment | again | t.isin(*DIRECTIVES)

    return F.forall(F.split(head(content, limit), "\n"), idle)


def found(content: Column, *patterns: str) -> Column:
    """What the patterns capture, pattern by pattern, each name once."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])))


def hooks(content: Column) -> Column:
    return found(content, r"\b(use[A-Z]\w+)\s*\(")


def exports(content: Column) -> Column:
    return found(content, *EXPORTS)


def prop_types(content: Column) -> Column:
    return found(content, *PROPS)


def top_level_functions(content: Column) -> Column:
    return found(content, r"(?:^|\n)(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(")


def component(jsx: Column, exported: Column, functions: Column) -> tuple[Column, Column]:
    """(is a component, its name): the first capitalised export, with markup else the first such function."""
    capital = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.rlike("^[A-Z]")), F.lit(1))
    name = F.when(jsx, F.coalesce(capital(exported), capital(functions))).otherwise(capital(exported))
    return jsx | name.isNotNull(), name


def nesting(content: Column) -> Column:
    """The deepest indentation in steps of two white spaces, of lines that are not blank."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"\S"))
    return F.coalesce(F.array_max(F.transform(lines, lambda x: F.floor(F.length(F.regexp_extract(x, r"^(\s*)", 1)) / 2))).cast("long"), F.lit(0))


def any_count(content: Column) -> Column:
    return F.regexp_count(content, F.lit(r":\s*any|as\s+any")).cast("long")


def file_meta(files: DataFrame) -> DataFrame:
    """files: path, content.  (path, lines, tokens, has_jsx, is_barrel, is_component, component, hooks, exports,
    prop_types, functions) of files that are neither styles, tests nor stories and have content."""
    p, c = F.col("path"), F.col("content")
    rows = files.filter(~is_style(p) & ~p.rlike(NO_META) & c.isNotNull()).select(p, head(c).alias("head"), line_count(c).alias("lines"), F.length(c).alias("chars"))
    h = F.col("head")
    rows = rows.select(p, "lines", "chars", h.rlike(STRICT_JSX).alias("has_jsx"), is_barrel(h).alias("is_barrel"), hooks(h).alias("hooks"), exports(h).alias("exports"), prop_types(h).alias("prop_types"), top_level_functions(h).alias("functions"))
    found, name = component(F.col("has_jsx"), F.col("exports"), F.col("functions"))
    return rows.select("path", "lines", estimated_tokens(p, F.col("chars"), F.col("has_jsx")).alias("tokens"), "has_jsx", "is_barrel", found.alias("is_component"), name.alias("component"), "hooks", "exports", "prop_types", "functions")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def split_thresholds(total: Column) -> dict[str, Column]:
    """Tokens at which folders are split, left whole, or merged; fixed defaults for an empty project."""
    r = lambda share, low, high: clamp(F.round(total * share), low, high)
    none = total <= 0
    return {
        "split": F.when(none, 50_000).otherwise(r(0.05, 20_000, 300_000)).cast("long"),
        "no_split": F.when(none, 30_000).otherwise(r(0.025, 10_000, 150_000)).cast("long"),
        "merge_min": F.when(none, 5_000).otherwise(r(0.003, 3_000, 15_000)).cast("long"),
    }


def cluster_thresholds(total: Column) -> dict[str, Column]:
    return {"max_tokens": clamp(F.round(total * 0.25), 1_000, 300_000).cast("long"), "min_tokens": clamp(F.round(total * 0.05), 50, 15_000).cast("long")}


def token_budget(tokens: Column, project: Column | None = None) -> Column:
    """Tokens granted to a task; ``project`` caps it at 30 % of the whole where it is given and positive."""
    b = F.when(tokens <= 10_000, tokens * 2.5 + 8_000).when(tokens <= 50_000, tokens * 2.0 + 10_000).otherwise(tokens * 1.5 + 15_000)
    b = F.round(b)
    if project is not None:
        b = F.when(project > 0, F.least(b, F.round(project * 0.3))).otherwise(b)
    return clamp(b, 15_000, 300_000).cast("long")
