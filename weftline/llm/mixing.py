"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Tokens (words of the text) are summed for each cell of source, language and topic.  Raking
multiplies the cells of each source, language and topic in turn until their weighted tokens have
the target marginals: the weights.  Probabilities are raked under their bound: each factor makes
the expected tokens of a value, with cells at 1 at most, what it can reach.  That is its target's
share of the wanted tokens, but all it has where that is less; the others of its dimension then
share the rest by their targets.  A document is taken if a hash of its id, a uniform number, lies
below its probability.  Only DataFrame functions.

Targets default to shares raised to ``flatten`` and normalised, so that rare sources gain.  Texts
are read once: what a document adds to its cell is written down in the shared folder, with the
columns asked for.  Cells number sources x languages x topics, not documents; up to ``CELLS`` of
them are raked in one partition, so that a sweep is sorts without a shuffle, more stay distributed.
The arithmetic is the same.  Raking goes on until no weight, or probability, changes by the tolerance
in a sweep; targets that contradict each other may never settle, and end after ``sweeps`` (twice as
many for probabilities) with a warning, or with an error if ``strict``.

Cases: null source or language is a category of its own (the empty string); a null text has no
tokens, topic "empty" and is never counted but can be sampled; repeated rows have one fate, being
one document; an empty table gives no rows; columns named like the operator's are no matter, as the
rows are numbered by position inside.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import durable, numbered, renamed, unit_interval

DIMENSIONS = ("_source", "_lang", "_topic")
#: Sweeps between two checkpoints.
AT_ONCE = 3
#: Cells, of some hundred bytes, that one partition rakes.
CELLS = 200_000


def words(text: Column) -> Column:
    """Number of words, without an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, n: Column) -> Column:
    """The form of a text, which stands for its topic where no column names one; fixed rules in this order."""
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.length(text), F.lit(1))
    return (
        F.when((n == 0) | text.isNull(), "empty")
        .when(share("#*$%&|<>{}[]=") > 0.02, "markup")
        .when(share("0123456789") > 0.05, "numbers")
        .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "capitals")
        .when(n < 100, "short prose")
        .when(n < 1000, "prose")
        .otherwise("long prose")
    )


def _bounded(rows: DataFrame, by: str, goal: str, whole: str, tie: list[str]) -> DataFrame:
    """_w times the factor f of each value of ``by`` for which the sum of n * min(1, _w * f) is its goal.

    With the rows of largest _w at 1 the sum is a line in f; the sum itself is the least of these
    lines, so that f is the largest of the places where they reach the goal.
    """
    rest = Window.partitionBy(by).orderBy("_w", *tie).rowsBetween(Window.unboundedPreceding, 0)
    line = F.try_divide(F.col(goal) - F.col(whole) + F.sum("n").over(rest), F.sum(F.col("n") * F.col("_w")).over(rest))
    most = F.coalesce(F.max("_line").over(Window.partitionBy(by)), F.lit(1.0))
    return rows.withColumn("_line", line).withColumn("_w", F.least(F.col("_w") * most, F.lit(1e12))).drop("_line")


def weigh(
    docs: DataFrame,
    fraction: float = 0.5,
    flatten: float = 0.5,
    targets: dict[str, dict[str, float]] | None = None,
    tolerance: float = 1e-4,
    sweeps: int = 200,
    strict: bool = False,
    seed: int = 7,
    source_col: str = "source",
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    topic_col: str | None = None,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """The columns ``carry`` of the rows (the id alone unless given) with _source, _lang, _topic,
    _tokens, _weight, _probability, _taken.

    targets: for any of source, lang, topic the wanted share of each value; values not named keep
    their default share; all are normalised.  ``topic_col``: a column that names each row's topic;
    without one it is the text's form (see ``topic``).  ``carry`` may not hold the names added here.
    """
    carry = (id_col,) if carry is None else carry
    if clash := {*DIMENSIONS, "_tokens", "_weight", "_probability", "_taken", "_drawn"}.intersection(carry):
        raise ValueError(f"columns {sorted(clash)} are added here")
    spark = docs.sparkSession
    text = F.col(text_col)
    drawn = unit_interval(F.col(id_col), F.lit(seed))
    rows = docs.withColumn("_tokens", words(text)).select(
        *carry, F.coalesce(F.col(source_col), F.lit("")).alias("_source"), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"),
        (F.coalesce(F.col(topic_col), F.lit("")) if topic_col else topic(text, F.col("_tokens"))).alias("_topic"), "_tokens", drawn.alias("_drawn"),
    )
    rows = durable(rows)
    cells = durable(rows.groupBy(*DIMENSIONS).agg(F.sum("_tokens").cast("double").alias("n")).filter("n > 0"))
    whole = cells.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c")).first()
    total = whole["t"]
    if total is None:  # no tokens: nothing to weigh
        return rows.withColumns({"_weight": F.lit(1.0), "_probability": F.lit(float(fraction)), "_taken": F.col("_drawn") < fraction}).drop("_drawn")
    together = (lambda c: c.coalesce(1)) if whole["c"] <= CELLS else (lambda c: c)
    cells = together(cells)

    wanted = min(1.0, fraction) * total
    # each cell carries, for its three values, the tokens they have, their goals, and what of them can be reached
    for d, name in zip(DIMENSIONS, ("source", "lang", "topic")):
        goal = cells.groupBy(d).agg(F.sum("n").alias("n"), F.pow(F.sum("n") / total, F.lit(flatten)).alias("g"))
        if named := (targets or {}).get(name):
            goal = goal.join(F.broadcast(spark.createDataFrame(list(named.items()), f"{d} string, own double")), d, "left").select(d, "n", F.coalesce("own", "g").alias("g"))
        goal = goal.withColumns({"_one": F.lit(0), "_w": F.col("g") / F.col("n"), "_goal": F.lit(wanted), "_all": F.lit(total), "g": F.col("g") / F.sum("g").over(Window.partitionBy(F.lit(0))) * total})
        goal = _bounded(goal, "_one", "_goal", "_all", [d])
        goal = durable(goal.select(d, F.col("n").alias(f"all{d}"), F.col("g").alias(f"goal{d}"), (F.col("n") * F.least(F.lit(1.0), "_w")).alias(f"reach{d}")).coalesce(1))
        cells = together(durable(cells.join(goal, d)))

    def sweep(c: DataFrame) -> DataFrame:
        for d in DIMENSIONS:
            now = F.sum(F.col("n") * F.col("_w")).over(Window.partitionBy(d))
            c = c.withColumn("_w", F.col("_w") * F.coalesce(F.try_divide(F.col(f"goal{d}"), now), F.lit(1.0)))
        return c

    def bounded_sweep(c: DataFrame) -> DataFrame:
        for d in DIMENSIONS:
            c = _bounded(c, d, f"reach{d}", f"all{d}", DIMENSIONS)
        return c

    def settled(c: DataFrame, step, value: Column, most: int, what: str) -> DataFrame:
        """After the sweep that changes ``value`` by less than the tolerance, or the last."""
        left = 0.0
        for at in range(0, most, AT_ONCE):
            for _ in range(min(AT_ONCE, most - at)):
                c = step(c.withColumn("_was", value))
            c = together(durable(c))
            left = c.agg(F.max(F.abs(value - F.col("_was")))).first()[0]
            if left < tolerance:
                return c
        said = f"raking of {what} ends at {most} sweeps with a last change of {left:.2g}"
        if strict:
            raise RuntimeError(said)
        warnings.warn(said, stacklevel=3)
        return c

    fitted = settled(cells.withColumn("_w", F.lit(1.0)), sweep, F.col("_w"), sweeps, "weights").withColumn("_weight", F.col("_w"))
    fitted = settled(fitted.withColumn("_w", F.col("_w") * fraction), bounded_sweep, F.least(F.lit(1.0), "_w"), 2 * sweeps, "probabilities")
    weights = fitted.select(*DIMENSIONS, "_weight", F.least(F.lit(1.0), "_w").alias("_probability"))
    weights = F.broadcast(weights) if whole["c"] <= CELLS else weights
    # cells without tokens (empty texts) keep weight 1
    out = rows.join(weights, list(DIMENSIONS), "left").withColumns({"_weight": F.coalesce("_weight", F.lit(1.0)), "_probability": F.coalesce("_probability", F.lit(float(fraction)))})
    return out.withColumn("_taken", F.col("_drawn") < F.col("_probability")).drop("_drawn").select(*carry, *DIMENSIONS, "_tokens", "_weight", "_probability", "_taken")


def mix(docs: DataFrame, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", topic_col: str | None = None, **how) -> DataFrame:
    """The sampled rows with the columns they came with."""
    rows, names = numbered(docs)
    got = weigh(rows, source_col=names[source_col], lang_col=names[lang_col], text_col=names[text_col], id_col=names[id_col], topic_col=topic_col and names[topic_col], carry=tuple(rows.columns), **how)
    return renamed(got.filter("_taken"), names)
