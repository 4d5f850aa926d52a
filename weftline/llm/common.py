"""Shared pieces of the llm operators: table access, durable cuts of lineage, components, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this subpackage: blank and \x09-\x0D.
#: ``bytes.split()`` without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints that the session names; only a local session may leave it
    unset, and gets a folder of this machine."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


#: Session setting: shuffle files go when their query ends, not whenever the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside give their shuffle files back when their action ends."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder; what was shuffled for it is given back."""
    checkpoint_dir(df.sparkSession)
    if not eager:
        return df.checkpoint(False)
    with freed(df.sparkSession):
        return df.select("*").checkpoint()


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named c0, c1, ..., so that no name of an operator clashes, and the new names."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Back to the columns that ``numbered`` got."""
    return rows.select(*names.values()).toDF(*names)


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def unit_interval(*keys: Column) -> Column:
    """A reproducible uniform number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def exact_rank(df: DataFrame, group: list[str], order: list[Column], spread: Column, buckets: int, name: str) -> DataFrame:
    """Adds a gapless rank from 0 within ``group`` without bringing a group into one task.

    Rows are ranked by (bucket, order), where ``spread`` gives the bucket (0 to buckets - 1); the
    table of offsets has at most groups x buckets rows and goes by an ordinary join.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_b", spread.cast("int"))
    sizes = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_b").orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(within) - 1)
    return ranked.join(offsets, [*group, "_b"]).withColumn(name, (F.col("_r") + F.col("_off")).cast("long")).drop("_b", "_r", "_off")


def components(nodes: DataFrame | None, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node with a link.

    edges: columns a, b (long), any direction, repeats and loops allowed; null ends are ignored.
    Alternates large-star and small-star steps (Kiveris et al., 2014), each a shuffle join, until
    no edge changes; a hub's neighbours are aggregated to a minimum and joined, never collected.
    ``nodes`` (column node) adds those without links as their own component.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = durable(tidy(edges.select("a", "b")))
    last = None
    for _ in range(rounds):
        two = both(e)
        low = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = tidy(two.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: every node links its smaller neighbours, and itself, to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = durable(tidy(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    linked = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    linked = linked.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    if nodes is None:
        return linked
    return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for words seen lately; the bound is on entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts (no nulls), one text's behind the other's, and the places where texts begin and end."""
    trimmed = pc.ascii_trim_whitespace(texts)
    words = pc.ascii_split_whitespace(trimmed)
    coded = words.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    found = hashes[coded.indices.to_numpy()]
    n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)  # gives one empty word
    if blank.any():
        found, n = found[~np.repeat(blank, n)], np.where(blank, 0, n)
    return found, np.concatenate([[0], n.cumsum()])


def give_back() -> None:
    """Memory that this worker's allocators hold free goes back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(batches: Iterator[Any], limit: int = 4_000_000) -> Iterator[Any]:
    """Slices of Arrow batches with about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        give_back()
