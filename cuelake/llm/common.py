"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` become spaces (after A-Z are lower-cased).
ALNUM_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: The same word class as a Java and RE2 pattern.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-cuelake-")
    return _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that survive a lost executor, and keeps column pruning for what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """A hash of a text that, with an id, tells rows apart; null texts have that of the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def held_out(col: Column, mod: int, remainder: int) -> Column:
    """Whether a row is kept from learning; a null id counts as not held out, and is not learned from either."""
    return F.coalesce(crc_mod(col, mod) == remainder, F.lit(False))


def sample_by_hash(df: DataFrame, cols: list[str], limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, the same at every run: those with the smallest hash of ``cols``."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), *cols).limit(limit)


#: Rows of more than this part of a sample's size are looked at last.
LARGE_PART = 64


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, mod: int, left_out: int, most: dict[int, int], size: Column, most_size: int, seed: int, name: str) -> DataFrame:
    """``(lid, y, text)``: labelled rows to learn from, of each 0/1 label ``y`` the first ``most[y]`` ids by a hash, and of these the first that keep the summed ``size`` (of ``text``) within ``most_size``.

    Rows of more than a LARGE_PART-th of ``most_size`` come after all others there, and those that are larger than all of it
    after these, so no row shuts out rows that would fit: only a class of nothing but rows over ``most_size`` is left empty.
    Ids whose crc32 as text mod ``mod`` is ``left_out`` and null ids aren't among them. Rows that repeat an id give one text.
    """
    known = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (crc_mod(F.col("lid"), mod) != left_out)).distinct()
    picked = None
    for y, rows in most.items():
        part = sample_by_hash(known.where(F.col("y") == y), ["lid"], rows, seed)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(picked), "lid").groupBy("lid", "y").agg(F.min("text").alias("text"))
    sample = materialize(sample.select("lid", "y", F.xxhash64(F.lit(seed), "lid").alias("at"), F.coalesce(size, F.lit(1)).cast("long").alias("size"), "text"), name)
    tier = F.when(F.col("size") * LARGE_PART <= most_size, 0).when(F.col("size") <= most_size, 1).otherwise(2)
    upto = F.sum("size").over(Window.partitionBy("y").orderBy(tier, "at", "lid"))  # numbers only, of most[0] + most[1] rows
    kept = sample.select("lid", "y", "at", "size").withColumn("upto", upto).where(F.col("upto") <= most_size).select("lid", "y")
    return sample.join(F.broadcast(kept), ["lid", "y"]).select("lid", "y", "text")


#: Keys that are sent to every executor at most, where one side of a join may hold very many rows of one key.
HEAVY_KEYS = 10_000


def join_heavy(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and, in ``n``, how many rows of ``left`` have it (dropped here); ``total`` rows in all.

    Keys of over ``total / HEAVY_KEYS`` rows, so HEAVY_KEYS of them at most, are sent to every executor and their rows stay
    where they are; the others are shuffled. Both tables are read twice, so they should be kept ones.
    """
    many = F.col(n) > max(1, total // HEAVY_KEYS)
    heavy, rest = right.where(many).drop(n), right.where(~many).drop(n)
    light = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return left.join(F.broadcast(heavy), key).unionByName(light.join(rest, key))


def keep_rows(docs: DataFrame, text_col: str, wanted: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, all columns, whose text ``wanted`` marks; in one pass without a shuffle. Spark bounds a batch by rows and bytes."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(wanted(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def chunks(n: int, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) over ``n`` items whose summed ``sizes`` stay within ``most`` (one item at least)."""
    a, total = 0, 0
    for i in range(n):
        if i > a and total + sizes[i] > most:
            yield a, i
            a, total = i, 0
        total += sizes[i]
    if n > a:
        yield a, n
