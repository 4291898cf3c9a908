"""Cross-entropy difference between a target and a background n-gram model over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, materialize

#: Words of the shared vocabulary, seen or not, and the weight of its even distribution in a bigram's.
VOCABULARY, MU = 10_000_000, 8.0
#: Features met most often in a sample of about SAMPLE_DOCS documents are counted apart and sent to every executor: so many at most.
HOT, SAMPLE_DOCS = 50_000, 20_000
#: Words and documents that a chunk holds, about, and bytes of text whose features make one bucket, about.
CHUNK_WORDS, CHUNK_DOCS, BUCKET_BYTES = 1_200_000, 30_000, 8 << 20
#: Sums that a task holds before it passes them on.
HELD_ROWS = 4_000_000
#: Ids that are sent to every executor, at most (8 MB); a longer list is joined by a shuffle.
BROADCAST_IDS = 1_000_000

_BITS = np.uint64((1 << 56) - 2)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(ALNUM_TABLE).split()


class Numbers(dict):
    """56-bit even numbers of words, made as they are met; forgets all of them at 300,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word) & 0xFFFFFFFFFFFFFE
        return n


def _pairs(h: np.ndarray) -> np.ndarray:
    """56-bit odd numbers of neighbouring words."""
    g = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(23))) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return (g & _BITS) | np.uint64(1)


def features(text: bytes | None, numbers: Numbers) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of a text, and its distinct features: numbers, and how often each occurs. Words have twice that, plus one for the last word."""
    ws = words_of(text)
    if not ws:
        return 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(numbers.__getitem__, ws), np.uint64, len(ws))
    w, k = np.unique(h, return_counts=True)
    k = 2 * k
    k[np.searchsorted(w, h[-1])] += 1
    g, m = np.unique(_pairs(h), return_counts=True)
    return len(ws), np.concatenate([w, g]), np.concatenate([k, m]).astype(np.int64)


def terms(keys: np.ndarray, own: np.ndarray, target: np.ndarray, counts: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """What a feature adds to the target and background loss of a document that holds it ``own`` times (as ``features`` gives it).

    ``counts``: of all documents and of the target, as word or bigram and as a word before another. A document's own
    occurrences are taken from both. Terms are those beyond an unseen feature's, so features met nowhere else add nothing.
    """
    pair = (keys & np.uint64(1)) == 1
    said = np.where(pair, own, own >> 1)
    before = np.where(pair, 0, (own >> 1) - (own & 1))
    out = []
    for n, c, scale, mine in ((counts[1], counts[3], 1.0, target), (counts[0], counts[2], rate, np.ones_like(target))):
        n, c = (n - said * mine) * scale, (c - before * mine) * scale
        out.append(0.5 * (before * np.log1p(c / MU) - said * np.log1p(n * np.where(pair, VOCABULARY / MU, 1.0))))
    return out[0], out[1]


def _pack(*columns: np.ndarray) -> bytes:
    """Unsigned columns of one length by byte planes, compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstd.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstd.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).reshape(-1).view(k))
        at += n * s
    return out


def _positions(hot: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted ``hot`` ones, and whether it is one."""
    at = np.minimum(np.searchsorted(hot, keys), max(0, len(hot) - 1))
    return at, (hot[at] == keys) if len(hot) else np.zeros(len(keys), bool)


def mark_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", name: str = "in_target") -> DataFrame:
    """``docs`` with a column that says whether the id is among ``ids(id_col)``. Texts stay where they are as long as the ids fit BROADCAST_IDS."""
    ids = materialize(ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("marked__")).distinct(), "target-ids")
    marked = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, docs[id_col] == ids["marked__"], "left")
    return marked.withColumn(name, F.col("marked__").isNotNull()).drop("marked__")


def cross_entropy_difference(docs: DataFrame, target_col: str = "in_target", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, loss_target, loss_background, score)``, one row for each row of ``docs``.

    The background model counts all words and bigrams of all ``docs``, the target model those of the rows that ``target_col``
    marks (null: not); both share the vocabulary and, after scaling the larger background, the amount of text. A document is
    scored by what all others say: its own occurrences are taken from every count. A loss is the mean of a unigram model's
    (add one) and a bigram model's (even distribution of weight MU), in nats a word; the first word has no bigram. ``score``
    is target minus background, lower for texts nearer to the target.

    Counts are exact and of all features. Features met often in a sample are counted in a first pass and sent to every
    executor, so no other feature fills a task. The second pass sends each document's other features to buckets by number,
    packed; a bucket counts its features and sends back what they add to each document. Words and bigrams are told apart by
    56-bit numbers (of 10^9 different ones about seven pairs share one, and then their counts).

    Texts without words, null ones too, have losses and score 0. An empty target knows nothing: its model is even. Null ids
    and repeated rows stay as they are, and a repeated row knows its likes; an empty table gives an empty result. Texts of
    any length are taken whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(F.col(target_col), F.lit(False)).alias("target"))
    rows, size = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(1, -(-size // BUCKET_BYTES))

    def commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            found = [features(t.as_py(), numbers)[1] for t in b.column(0)]
            if found:
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                many = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[many].astype(np.int64)), pa.array(n[many].astype(np.int64))], names=["key", "n"])

    seen = base.sample(min(1.0, SAMPLE_DOCS / max(1, rows)), 7).select("text").mapInArrow(commonest, "key long, n long")
    top = seen.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "key").limit(HOT).select("key").toPandas()
    hot = spark.sparkContext.broadcast(np.sort(top["key"].to_numpy(np.uint64)))

    def count_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the hot features, and in one more place those of all words; as ``terms`` takes them."""
        numbers, h = Numbers(), hot.value
        out = np.zeros((4, len(h) + 1), np.int64)
        for b in batches:
            for t, mine in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                n, keys, own = features(t.as_py(), numbers)
                at, is_hot = _positions(h, keys)
                keys, own, at = keys[is_hot], own[is_hot], at[is_hot]
                pair = (keys & np.uint64(1)) == 1
                said, before = np.where(pair, own, own >> 1), np.where(pair, 0, (own >> 1) - (own & 1))
                for k in (0, 1) if mine else (0,):
                    out[k, at] += said
                    out[k + 2, at] += before
                    out[k, -1] += n
        at = np.flatnonzero(out.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x[at]) for x in out]], names=["at", "n0", "n1", "c0", "c1"])

    hot_rows = base.mapInArrow(count_hot, "at long, n0 long, n1 long, c0 long, c1 long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "c0", "c1")]).toPandas()
    hot_counts = np.zeros((4, len(hot.value) + 1), np.int64)
    hot_counts[:, hot_rows["at"].to_numpy(np.int64)] = hot_rows[["n0", "n1", "c0", "c1"]].to_numpy(np.int64).T
    total, total_target = int(hot_counts[0, -1]), int(hot_counts[1, -1])
    rate = total_target / total if total else 0.0
    known = spark.sparkContext.broadcast(hot_counts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of documents: a row with their ids, words and sums of hot features, and a row for each bucket with the others."""
        numbers, h = Numbers(), hot.value
        chunk, id_type = TaskContext.get().partitionId() << 24, None
        held: list[tuple] = []
        names = ["bucket", "chunk", "blob", "ids"]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            n = np.array([x[1] for x in held], np.int64)
            mine = np.array([x[2] for x in held], np.int64)
            keys, own = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
            row = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
            at, is_hot = _positions(h, keys)
            add = terms(keys[is_hot], own[is_hot], mine[row[is_hot]], known.value[:, at[is_hot]], rate)
            sums = [np.bincount(row[is_hot], weights=a, minlength=len(held)) for a in add]
            # What all features have in common: the models' totals, without the document's own words.
            whole = n * np.log(np.array([total_target - n * mine, (total - n) * rate]) + VOCABULARY)
            const = 0.5 * (whole + np.maximum(0, n - 1) * np.log(VOCABULARY))
            head = _pack(n.astype(np.uint64), (sums[0] + const[0]).view(np.uint64), (sums[1] + const[1]).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([chunk % buckets], pa.int32()), pa.array([chunk]), pa.array([head]), pa.array([[x[0] for x in held]], pa.list_(id_type))], names=names)
            keys, own, row = keys[~is_hot], own[~is_hot], row[~is_hot]
            order = np.argsort(keys)
            keys, own, row = keys[order], own[order], row[order]
            bucket = ((keys >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            at_bucket, blobs = [], []
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if b > a:
                    at_bucket.append(int(bucket[a]))
                    blobs.append(_pack(np.diff(keys[a:b], prepend=np.uint64(0)), own[a:b].astype(np.uint32), (2 * row[a:b] + mine[row[a:b]]).astype(np.uint16)))
            for i in range(0, len(blobs), 64):
                part = blobs[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array(at_bucket[i : i + 64], pa.int32()), pa.array([chunk] * len(part)), pa.array(part, pa.binary()), pa.nulls(len(part), pa.list_(id_type))], names=names)
            held.clear()
            chunk += 1

        words = 0
        for b in batches:
            id_type = b.schema.field(0).type
            for i, t, mine in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                n, keys, own = features(t.as_py(), numbers)
                held.append((i, n, int(mine), keys, own))
                words += n
                if words > CHUNK_WORDS or len(held) >= CHUNK_DOCS:
                    yield from flush()
                    words = 0
        if held:
            yield from flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket by bucket: counts of its features, and what they add to the documents, summed over the task's buckets."""
        sums: dict[int, np.ndarray] = {}
        bucket, held, size, id_type = None, [], 0, None

        def close() -> None:
            nonlocal size
            if not held:
                return
            parts = [(c, *_unpack(blob, np.uint64, np.uint32, np.uint16)) for c, blob in held]
            held.clear()
            keys = np.concatenate([np.cumsum(d, dtype=np.uint64) for _, d, _, _ in parts])
            own, row = (np.concatenate([p[j] for p in parts]).astype(np.int64) for j in (2, 3))
            mine = row & 1
            distinct, at = np.unique(keys, return_inverse=True)
            pair = (keys & np.uint64(1)) == 1
            said, before = np.where(pair, own, own >> 1), np.where(pair, 0, (own >> 1) - (own & 1))
            counts = np.array([np.bincount(at, weights=w, minlength=len(distinct)) for w in (said, said * mine, before, before * mine)])
            add = terms(keys, own, mine, counts[:, at], rate)
            a = 0
            for c, d, _, r in parts:
                b = a + len(d)
                rows_ = r >> 1
                more = np.array([np.bincount(rows_, weights=x[a:b]) for x in add])
                old = sums.get(c, np.zeros((2, 0)))
                if more.shape[1] < old.shape[1]:
                    more, old = old, more
                more[:, : old.shape[1]] += old
                size += more.shape[1] - (old.shape[1] if c in sums else 0)
                sums[c] = more
                a = b

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for c, s in sums.items():
                at = np.flatnonzero(s.any(axis=0))
                blob = _pack(at.astype(np.uint16), *[x[at].astype(np.float32).view(np.uint32) for x in s])
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([blob]), pa.nulls(1, pa.list_(id_type))], names=["chunk", "blob", "ids"])
            sums.clear()
            size = 0

        for b in batches:
            id_type = b.schema.field(3).type.value_type
            for k, c, blob, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if ids.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([blob.as_py()]), pa.array([ids.as_py()], pa.list_(id_type))], names=["chunk", "blob", "ids"])
                    continue
                if k != bucket:
                    close()
                    bucket = k
                    if size > HELD_ROWS:
                        yield from flush()
                held.append((c, blob.as_py()))
        close()
        if sums:
            yield from flush()

    def finish(t: pa.Table) -> pa.Table:
        heads = t.column("ids").is_valid().to_pylist()
        i = heads.index(True)
        n, *losses = _unpack(t.column("blob")[i].as_py(), np.uint64, np.uint64, np.uint64)
        losses = [x.view(np.float64).copy() for x in losses]
        # In a fixed order, so that sums don't depend on which task came first.
        for blob in sorted(b.as_py() for b, h in zip(t.column("blob"), heads, strict=True) if not h):
            at, *more = _unpack(blob, np.uint16, np.uint32, np.uint32)
            for x, m in zip(losses, more, strict=True):
                x[at] += m.view(np.float32)
        means = [np.where(n > 0, x / np.maximum(n, 1), 0.0) for x in losses]
        return pa.table({"doc_id": t.column("ids")[i].values, "n_words": n.astype(np.int64), "loss_target": means[0], "loss_background": means[1]})

    packed = base.mapInArrow(pack, f"bucket int, chunk long, blob binary, ids array<{kind}>")
    back = materialize(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(reduce, f"chunk long, blob binary, ids array<{kind}>"), "lm-sums")
    out = back.groupBy("chunk").applyInArrow(finish, f"doc_id {kind}, n_words long, loss_target double, loss_background double")
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))
