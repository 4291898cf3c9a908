"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, join_heavy, materialize, text_key

#: A shared span counts from WINDOW words on. K-grams of K words, the least of each SPREAD neighbours kept: K + SPREAD - 1 = WINDOW,
#: so any WINDOW shared words hold a k-gram that both sides have kept.
WINDOW, K, SPREAD = 10, 6, 5
SIDE = WINDOW - K
#: Bits of the filter over benchmark fingerprints: at most 2**27 (16 MB), whatever the benchmark's size.
FILTER_BITS_MAX = 27
#: Places of the benchmark up to this many are sent to every executor; beyond, they are joined by a shuffle, all but heavy keys.
BROADCAST_PLACES = 20_000

ANCHOR = "struct<kind:int,pos:int,hash:long,ctx:array<binary>>"
_ANCHOR_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("pos", pa.int32()), ("hash", pa.int64()), ("ctx", pa.list_(pa.binary()))]))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words seen so far; forgets all of them at a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(ALNUM_TABLE).split()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring word hashes."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _PRIME + h[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _kept(g: np.ndarray) -> np.ndarray:
    """Whether each k-gram is the least of some window of SPREAD neighbours (all equal ones of it)."""
    m = len(g) - SPREAD + 1
    low = g[:m].copy()
    for j in range(1, SPREAD):
        np.minimum(low, g[j : j + m], out=low)
    keep = np.zeros(len(g), bool)
    for j in range(SPREAD):
        keep[j : j + m] |= g[j : j + m] == low
    return keep


def anchors(words: list[bytes], short: list[int], passes: Callable[[np.ndarray], np.ndarray] | None) -> list[dict]:
    """Fingerprints of a word list, each with the words around it that a window through it can reach.

    ``short``: lengths of benchmark items under WINDOW words, looked for whole. ``passes``: hashes worth keeping.
    """
    n = len(words)
    if not n:
        return []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    out: list[dict] = []
    for kind in [*[x for x in short if x <= n], *[WINDOW] * (n >= WINDOW)]:
        g = _grams(h, K if kind == WINDOW else kind)
        keep = _kept(g) if kind == WINDOW else np.ones(len(g), bool)
        if kind != WINDOW:
            g = g + np.uint64(kind)
        if passes is not None:
            at = np.flatnonzero(keep)
            at = at[passes(g[at])]
        else:
            at = np.flatnonzero(keep)
        for p in at.tolist():
            if kind == WINDOW:
                ctx = [words[i] if 0 <= i < n else None for i in range(p - SIDE, p + K + SIDE)]
            else:
                ctx = words[p : p + kind]
            out.append({"kind": kind, "pos": p, "hash": int(g[p].astype(np.int64)), "ctx": ctx})
    return out


def _map_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b.column(1).cast(pa.binary()):
            w = words_of(t.as_py())
            rows.append(anchors(w, [len(w)] if len(w) < WINDOW else [], None))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _ANCHOR_TYPE)], names=["item_id", "anchors"])


def _map_docs(bits: int, packed: str, short: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(base64.b64decode(packed), np.uint8)
        mask = np.uint64((1 << bits) - 1)

        def passes(g: np.ndarray) -> np.ndarray:
            at = g & mask
            return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for b in batches:
            rows, counts = [], []
            for t in b.column(2).cast(pa.binary()):
                w = words_of(t.as_py())
                counts.append(len(w))
                rows.append(anchors(w, short, passes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(rows, _ANCHOR_TYPE)], names=["doc_id", "tkey", "n_words", "anchors"])

    return run


def _run_length(ctx: str, ictx: str, at: range) -> Column:
    """Equal words from the anchor outwards, up to the first difference."""
    out: Column = F.lit(len(at))
    for steps in reversed(range(len(at))):
        same = F.coalesce(F.col(ctx)[at[steps]] == F.col(ictx)[at[steps]], F.lit(False))
        out = F.when(~same, F.lit(steps)).otherwise(out)
    return out


def _filter(items: DataFrame) -> tuple[int, str, list[int], int]:
    """Bits, bitmap and the short lengths of the benchmark's anchors. Sent to the driver: at most 2**FILTER_BITS_MAX bits."""
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("kind") < WINDOW, F.col("kind"))).alias("short")).first()
    n = facts["n"]
    bits = min(FILTER_BITS_MAX, max(16, (16 * n).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    set_bytes = items.select(F.shiftrightunsigned(at, 3).cast("int").alias("byte"), F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int")).alias("bit"))
    found = set_bytes.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    bitmap[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint8)
    return bits, base64.b64encode(bitmap.tobytes()).decode(), sorted(facts["short"]), n


def _prepare(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their anchors, ``(doc_id, tkey, n_words, anchors)``; the verified spans ``(doc_id, tkey, place, span)``; and ``(place, item_ids)``.

    ``tkey`` is a hash of the text: with the id it names a row up to repeated ones, whose results are alike. A ``place`` is
    an anchor with the words around it, by their digest: items that share a passage share its places, so documents are
    compared once with each, however many items hold it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("item_id").isNotNull())
    items = items.mapInArrow(_map_items, f"item_id string, anchors array<{ANCHOR}>")
    shown = F.array_join(F.transform("ictx", lambda w: F.coalesce(w.cast("string"), F.lit("\n"))), " ")
    items = items.select("item_id", F.explode("anchors").alias("a")).select("item_id", "a.kind", "a.hash", F.col("a.ctx").alias("ictx"))
    items = materialize(items.withColumn("place", F.sha2(F.concat_ws(" ", F.col("kind").cast("string"), shown), 256)).distinct(), "benchmark-anchors")
    places = materialize(items.groupBy("place").agg(F.first("kind").alias("kind"), F.first("hash").alias("hash"), F.first("ictx").alias("ictx"), F.array_sort(F.collect_set("item_id")).alias("item_ids")), "benchmark-places")
    bits, packed, short, n_places = _filter(places)

    base = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    base = materialize(base.mapInArrow(_map_docs(bits, packed, short), f"doc_id {kind}, tkey long, n_words long, anchors array<{ANCHOR}>"), "document-anchors")

    found = base.where(F.size("anchors") > 0).select("doc_id", "tkey", F.explode("anchors").alias("a")).select("doc_id", "tkey", "a.kind", "a.hash", "a.pos", "a.ctx")
    if n_places <= BROADCAST_PLACES:
        joined = found.join(F.broadcast(places.drop("item_ids")), ["kind", "hash"])
    else:
        found = materialize(found.withColumn("key", F.struct("kind", "hash")), "found-anchors")
        met = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        of_key = places.groupBy(F.struct("kind", "hash").alias("key")).agg(F.collect_list(F.struct("place", "ictx")).alias("p")).join(met, "key")
        joined = join_heavy(found, materialize(of_key, "met-places"), "key", "n", found.count()).select("*", F.inline("p")).drop("p", "key")
    middle = F.lit(True)
    for i in range(SIDE, SIDE + K):
        middle &= F.col("ctx")[i] == F.col("ictx")[i]
    left, right = _run_length("ctx", "ictx", range(SIDE - 1, -1, -1)), _run_length("ctx", "ictx", range(SIDE + K, SIDE + K + SIDE))
    spans = joined.select(
        "doc_id", "tkey", "place", "kind", "pos",
        F.when(F.col("kind") == WINDOW, left).otherwise(0).alias("left"),
        F.when(F.col("kind") == WINDOW, right + K).otherwise(F.col("kind")).alias("right"),
        F.when(F.col("kind") == WINDOW, middle).otherwise(F.col("ctx") == F.col("ictx")).alias("same"),
    ).where(F.col("same") & (F.col("left") + F.col("right") >= F.col("kind")))
    spans = spans.select("doc_id", "tkey", "place", F.struct((F.col("pos") - F.col("left")).alias("a"), (F.col("pos") + F.col("right")).alias("b")).alias("span"))
    return base, spans, places.select("place", "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark window. Cases as in ``decontaminate``."""
    _, spans, _ = _prepare(docs, benchmark, id_col, text_col, item_col, item_text_col)
    bad = materialize(spans.select(F.col("doc_id").alias("bad_id__"), F.col("tkey").alias("bad_key__")).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("bad_id__")) & (text_key(docs[text_col]) == F.col("bad_key__")), "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of each document that lie in a benchmark window, one row for each row of ``docs``.

    ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``. A window is WINDOW consecutive item words, or a
    shorter item whole. Each side keeps winnowed fingerprints; those of documents that pass a filter over the benchmark's
    are joined to it by hash and extended by comparing the words themselves, so no hash collision counts. Keys with very
    many document rows stay where those rows are.

    Null texts have no words; empty tables give no rows, or no hits. Items without words, or with a null id, hit nothing
    (an id is needed to name them); repeated items and item ids count once. Repeated document rows each get their row,
    and a null document id is kept. Texts of any length are taken whole. Other columns are ignored.
    """
    base, spans, places = _prepare(docs, benchmark, id_col, text_col, item_col, item_text_col)
    touched = base.where(F.size("anchors") > 0)
    union = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["to"], x["b"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["to"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )
    spans = materialize(spans.distinct(), "spans")
    held = spans.select("doc_id", "tkey", "place").distinct()
    met = held.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    named = materialize(places.join(met, "place"), "met-items")
    ids = join_heavy(held, named, "place", "n", spans.count()).select("doc_id", "tkey", F.explode("item_ids").alias("item_id"))
    ids = ids.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).select(F.col("doc_id").alias("ids_doc"), F.col("tkey").alias("ids_key"), "ids")
    hits = spans.groupBy("doc_id", "tkey").agg(F.collect_set("span").alias("spans")).join(ids, F.col("doc_id").eqNullSafe(F.col("ids_doc")) & (F.col("tkey") == F.col("ids_key")))
    hits = hits.select(F.col("doc_id").alias("hit_doc"), F.col("tkey").alias("hit_key"), union.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    clean = [F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256")]
    rest = base.where(F.size("anchors") == 0).select("doc_id", "n_words", *clean)
    met = (
        touched.select("doc_id", "tkey", "n_words")
        .join(hits, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("tkey") == F.col("hit_key")), "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    )
    return rest.unionByName(met).withColumn("contaminated", F.col("n_hit") > 0)
