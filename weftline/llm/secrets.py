"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Two first-order Markov models, one of random strings and one of ordinary identifiers, are trained
from labelled samples by grouped counts; a run of ``[A-Za-z0-9+/_=-]`` of 20 characters or more is
a secret when the log-likelihood ratio of the two reaches a bound in total and for each character.
The table of ratios has a fixed size (65 x 65 integers in thousandths of a nat, one row and column
for the start), so that it travels in the plan as a constant.  Only DataFrame functions are used.

Spans are kind:start:end in code points, end exclusive.  Cases: a null text is empty and has no
spans; texts of any length are read whole; repeated rows give repeated results; an empty table
gives no rows; other columns are carried by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import numbered, renamed

# The base patterns and the least lengths of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"  # the look-behind spares a scan from each character of a word
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio, in thousandths, that a run needs in total and for each character.
LEAST_TOTAL, LEAST_EACH = 8_000, 350

# Parts of ordinary identifiers.
PARTS = (
    "account action active address agent amount api array async auth backup batch block body buffer build button cache call "
    "category change channel check child class client code collection column command comment commit config connection content "
    "context control count create current customer data database date default delete description detail device directory display "
    "document domain download element email enable entry error event exception export failure feature field file filter first "
    "format frame function gateway generate global group handler header history host http identifier image import index input "
    "instance interface internal item job json key label language last layout length level library limit line link list listener "
    "local location manager map message method metric mode model module monitor name network node notification number object offset "
    "operation option order output package page parameter parent parse password path payment performance permission platform plugin "
    "policy port prefix process product profile project property protocol provider proxy query queue random range read record "
    "reference region registry remote render report repository request resource response result return role route rule schedule schema "
    "scope search section secret security select selection sequence server service session setting shared source stage start state "
    "status storage store stream string style subject summary support switch sync system table target task template test text thread "
    "time timeout title token tool total track transaction transfer tree type update upload url user utility validation value variable "
    "version view virtual visible warning widget width window worker workspace write year zone"
).split()


def default_samples(spark: SparkSession, n: int = 500) -> DataFrame:
    """(label, value): label 1 random, 0 ordinary; made by a rule, the same each time."""
    words = F.array(*[F.lit(x) for x in PARTS])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    ids = spark.range(0, n, 1, 1)
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    alone = F.regexp_replace(b64, "[+/=]", "")
    spans = lambda *xs: F.array(*xs)
    random = ids.select(F.lit(1).alias("label"), F.explode(spans(
        F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), F.substring(b64, 1, 40), alone, F.translate(b64, "+/=", "-_"),
    )).alias("value"))
    five = [word(k) for k in range(5)]
    year = (F.pmod(F.xxhash64("id"), F.lit(60)) + 1970).cast("string")
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(10_000_000_000)).cast("string")
    ordinary = ids.select(F.lit(0).alias("label"), F.explode(spans(
        F.concat_ws("_", *five[:3]), F.upper(F.concat_ws("_", *five[1:4])), F.concat_ws("", *five[2:5]), F.upper(F.concat_ws("", *five[2:5])),
        F.concat(five[0], *[F.initcap(x) for x in five[1:4]]), F.concat(*[F.initcap(x) for x in five[:4]]), F.concat_ws("-", *five[1:5]),
        F.concat_ws("/", *five[:4]), F.concat(five[3], F.lit("_"), year, F.lit("-"), five[4]), F.concat(F.lit("+"), number, number),
        F.concat_ws("-", year, year, year, year), F.repeat(F.substring(F.lit("=-_"), (F.pmod(F.col("id"), F.lit(3)) + 1).cast("int"), F.lit(1)), 24),
    )).alias("value"))
    return random.unionAll(ordinary)


def train(samples: DataFrame) -> str:
    """The table of ratios, joined by commas: rows are the character before (0 the start), columns the next.

    samples: label (1 random, 0 ordinary), value; nulls are ignored.  The counts are grouped by
    pair of characters: 65 x 65 x 2 rows at most, whatever the number of samples.
    """
    size = len(ALPHABET) + 1
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    codes = samples.filter("value is not null and label is not null").select("label", F.concat(F.array(F.lit(0)), F.transform(chars, code)).alias("c"))
    pairs = codes.select("label", F.explode(F.expr("transform(sequence(1, greatest(size(c) - 1, 1)), i -> if(i < size(c), struct(c[i - 1] as a, c[i] as b), null))")).alias("p"))
    counts = pairs.filter("p is not null").groupBy("label", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    spark = samples.sparkSession
    grid = spark.range(size * size).select((F.col("id") / size).cast("int").alias("a"), (F.col("id") % size).cast("int").alias("b"))
    wide = counts.groupBy("a", "b").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    rows = wide.groupBy("a").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    p = lambda k: (F.coalesce(F.col(f"n{k}"), F.lit(0)) + 0.5) / (F.coalesce(F.col(f"t{k}"), F.lit(0)) + 0.5 * size)
    ratio = F.round(1000 * F.ln(p(1) / p(0))).cast("int")
    table = grid.join(wide, ["a", "b"], "left").join(rows, "a", "left").select("a", "b", ratio.alias("r"))
    return table.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "r"))), lambda x: x["r"].cast("string")), ",")).first()[0]


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: the leftmost non-overlapping matches with their code points.

    A text is cut at its matches; lengths of the pieces between and of the matches add up.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<s:int, e:int, m:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    zipped = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _ratio(model: str) -> tuple:
    """Functions of a run: its summed ratio."""
    size = len(ALPHABET) + 1
    model_col = F.split(F.lit(model), ",").cast("array<int>")

    def score(run: Column) -> Column:
        codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
        step = lambda acc, c: F.struct((acc["t"] + F.element_at(model_col, acc["p"] * size + c + 1)).alias("t"), c.alias("p"))
        return F.aggregate(codes, F.struct(F.lit(0).alias("t"), F.lit(0).alias("p")), step)["t"]

    return score


def with_spans(docs: DataFrame, model: str | None = None, text_col: str = "text", name: str = "spans") -> DataFrame:
    """Adds ``name``: array<struct<start, kind, end>>, sorted by start, then kind as in KINDS."""
    model = model or train(default_samples(docs.sparkSession))
    score = _ratio(model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda kind: lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"))
    rows = docs.withColumns({
        "_a": F.filter(_placed(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12),
        "_k": _placed(text, ACCESS),
        "_h": _placed(text, HEX),
        "_m": F.filter(_placed(text, RUN), lambda x: score(x["m"]) >= F.greatest(F.lit(LEAST_TOTAL), LEAST_EACH * F.length(x["m"]))),
    })
    base = F.concat(F.transform("_a", span(0)), F.transform("_k", span(1)), F.transform("_h", span(2)))
    rows = rows.withColumn("_base", F.array_sort(base))
    # a run that touches a base span is that secret, found already
    free = F.filter("_m", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["e"]) & (b["end"] > x["s"])))
    return rows.withColumn(name, F.array_sort(F.concat("_base", F.transform(free, span(3))))).drop("_a", "_k", "_h", "_m", "_base")


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text", "found")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count(3).alias("n_markov"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", model: str | None = None, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by ``mark``; overlapping spans become one."""
    rows, names = numbered(docs)
    text_col = names[text_col]
    rows = with_spans(rows, model, text_col, "_found")
    step = lambda acc, x: F.when(
        x["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"), x["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at")))
    folded = F.aggregate("_found", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return renamed(rows.withColumn(text_col, F.when(F.size("_found") > 0, folded).otherwise(F.col(text_col))), names)
