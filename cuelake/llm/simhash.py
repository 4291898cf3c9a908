"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as Wn

from .common import join_heavy, materialize, text_key
from .components import components

SHINGLE = 3
DISTANCE = 2
#: Fetching all members of a table entry stops paying beyond this many; larger entries take the exact ball route.
HOT_ENTRY = 64

_BLOCK = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of one UTF-8 text, unsigned; 0 for null and for texts without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    if n == 0:
        return 0
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    counts, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, _BLOCK):
        parts = [joined[a:b] for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)]
        h = np.array(list(map(xxhash.xxh64_intdigest, parts, repeat(42))), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _map_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).cast(pa.binary())
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(fps)], names=["doc_id", "tkey", "fp"])


def whole_id(docs: DataFrame, id_col: str) -> Column:
    """Ids as long; null for those that are no whole number."""
    return docs[id_col].try_cast("long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tkey, fp)`` for every row; ``fp`` holds the 64 bits as a signed long, ``tkey`` a hash of the text."""
    return docs.select(whole_id(docs, id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text")).mapInArrow(_map_fingerprints, "doc_id long, tkey long, fp long")


def _halves(fp: DataFrame) -> DataFrame:
    """Two index rows per fingerprint: segment number and its 32 bits."""
    return fp.select(
        "fp",
        F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("seg", "val"),
    )


def links(fp: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` between different fingerprints that connect exactly the pairs within two differing bits.

    ``fp``: distinct fingerprints. Two of them at distance 2 or less agree in one 32-bit segment up to one bit, so each
    is looked up in the table of either segment at its own value and at each value with one set bit cleared (of two
    values one bit apart, just one has that bit set). Candidates are kept after comparing all 64 bits.

    Table entries of more than HOT_ENTRY fingerprints would give pairs in the square of their size. The fingerprints that
    lie in one or look one up take an equally exact route instead: each is sent to the 65 values of its ball of radius 1 over
    all 64 bits. Two are within distance 2 just if they share a value there, no value has over 65 senders, and linking the
    senders of a value to the smallest of them gives the same components with at most 65 rows per fingerprint.
    """
    table = _halves(fp)
    sizes = table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > HOT_ENTRY).select("seg", "val", F.lit(True).alias("hot"))
    probes = table.select(
        F.col("fp").alias("q"),
        "seg",
        F.explode(
            F.concat(
                F.array("val"),
                F.transform(
                    F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.getbit("val", b) == 1),
                    lambda b: F.col("val").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)),
                ),
            )
        ).alias("look"),
        "val",
    )
    index = table.join(hot, ["seg", "val"], "left_anti").select("seg", F.col("val").alias("look"), "fp")
    near = (
        probes.join(index, ["seg", "look"])
        .where((F.col("look") != F.col("val")) | (F.col("q") < F.col("fp")))
        .where(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= DISTANCE)
        .select(F.col("q").alias("u"), F.col("fp").alias("v"))
    )
    touched = (
        probes.join(hot.select("seg", F.col("val").alias("look")), ["seg", "look"], "left_semi").select(F.col("q").alias("fp")).distinct()
    )
    ball = touched.select(
        "fp",
        F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))).alias("val"),
    )
    star = (
        ball.withColumn("low", F.min("fp").over(Wn.Window.partitionBy("val")))
        .where(F.col("fp") != F.col("low"))
        .select(F.col("fp").alias("u"), F.col("low").alias("v"))
    )
    return near.unionByName(star).distinct()


def _classes(fps: DataFrame) -> DataFrame:
    """``(fp, first_id, n, root)``: the component of every fingerprint, its smallest id and its number of rows."""
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "fingerprint-groups")
    roots = components(links(groups.select("fp")))
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns: of each component the row with the smallest id (nulls last), one of rows that repeat it.

    Cases as in ``near_duplicates``.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    rows = fps.groupBy("fp", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey", "n"))
    named = rows.groupBy("fp").agg(first.alias("row")).join(_classes(fps).select("fp", "root"), "fp")
    kept = named.groupBy("root").agg(F.min("row").alias("row"))
    kept = materialize(kept.select(F.col("row.doc_id").alias("kept_id__"), F.col("row.tkey").alias("kept_key__"), F.col("row.n").alias("kept_n__")), "kept-rows")
    whole = docs.join(kept, whole_id(docs, id_col).eqNullSafe(F.col("kept_id__")) & (text_key(docs[text_col]) == F.col("kept_key__")))
    once = whole.where(F.col("kept_n__") == 1).unionByName(whole.where(F.col("kept_n__") > 1).dropDuplicates(["kept_id__", "kept_key__"]))
    return once.drop("kept_id__", "kept_key__", "kept_n__")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Copies share a fingerprint and meet in one aggregated row before any search, so groups of thousands cost one entry.
    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows each get a row. A null id
    or one that is no whole number, stays null and doesn't count for ``component_id``, which is null only if the component holds no id at all. An empty
    table gives an empty result. Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _classes(fps)
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = materialize(named.join(lowest, "root").select("fp", "component_id", "n"), "fingerprint-components")
    return join_heavy(fps, lookup, "fp", "n", fps.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
