"""Language identification by nearest TF-IDF centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, held_out, keep_rows, materialize

#: Slots that letter n-grams are hashed to, clusters of a language, and labelled documents that are learned from (about, in all languages, and one of each language at least).
SLOTS, CLUSTERS, SAMPLE = 4096, 4, 4000
#: One document in so many is kept from the clusters and shows how near documents of a language are that the centroids haven't seen.
KEPT_BACK = 3
#: A document is rejected when its best cosine is more than SIGMAS deviations (LEAST_SIGMA at least) under the mean of those kept back
#: of its language and length, and under REJECT_SHARE of the least of them.
SIGMAS, LEAST_SIGMA, REJECT_SHARE = 6.0, 0.02, 0.9
#: Documents that a length needs for numbers of its own; with fewer the next shorter lengths are taken in.
LENGTH_ROWS = 12
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of letter 1-, 2- and 3-grams of the whole text, words padded by one space; None without any letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    if not text:
        return None
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.where(letter, code, 32)[keep].astype(np.uint32)
    one, two, three = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA6B), c * np.uint32(0xC2B2AE35)
    grams = np.concatenate([one, one[:-1] ^ (two[1:] + np.uint32(1)), one[:-2] ^ two[1:-1] ^ three[2:]])
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    return np.bincount(grams >> np.uint32(32 - 12), minlength=SLOTS)


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1.0).astype(int), 24)


class Centroids:
    """Unit centroids per language, the inverse document frequencies, and the least cosine that a language and length accept.

    ``x``: log counts of n-grams in single precision, changed in place. Rows of languages with few documents serve both as
    members of clusters and to set the floors.
    """

    def __init__(self, x: np.ndarray, langs: list[str]):
        n = len(x)
        self.names = sorted(set(langs))
        self.idf = np.log((1.0 + n) / (1.0 + (x > 0).sum(axis=0))) + 1.0 if n else np.ones(SLOTS)
        length = _bucket(np.expm1(x).sum(axis=1)) if n else np.zeros(0, int)
        for i in range(0, n, 256):
            x[i : i + 256] *= self.idf.astype(np.float32)
            x[i : i + 256] /= np.maximum(np.linalg.norm(x[i : i + 256], axis=1, keepdims=True), 1e-12)
        rows: dict[str, list[int]] = {name: [] for name in self.names}
        for j, lang in enumerate(langs):
            rows[lang].append(j)
        self.owner, parts, back = [], [], {}
        for i, name in enumerate(self.names):
            own = np.array(rows[name])
            few = len(own) < 2 * KEPT_BACK
            back[i] = own if few else own[::KEPT_BACK]
            for c in self._cluster(x[own if few else np.delete(own, np.s_[::KEPT_BACK])]):
                parts.append(c)
                self.owner.append(i)
        self.owner = np.array(self.owner, int)
        self.matrix = np.array(parts, np.float64).T.copy() if parts else np.zeros((SLOTS, 0))
        self.floor = np.zeros((len(self.names), 25))
        for i, own in back.items():
            self.floor[i] = self._floors((x[own] @ self.matrix[:, self.owner == i].astype(np.float32)).max(axis=1), length[own])

    @staticmethod
    def _floors(best: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The least cosine by length. Copies count once; longer texts never ask for less than shorter ones."""
        best, at = np.unique(best, return_index=True)
        length, out = length[at], np.zeros(25)
        for k in range(25):
            low = k
            while low > 0 and ((length >= low) & (length <= k)).sum() < LENGTH_ROWS:
                low -= 1
            seen = best[(length >= low) & (length <= k)]
            if len(seen) >= LENGTH_ROWS:
                out[k] = max(0.0, min(seen.mean() - SIGMAS * max(LEAST_SIGMA, seen.std()), REJECT_SHARE * seen.min()))
        return np.maximum.accumulate(out)

    @staticmethod
    def _cluster(x: np.ndarray) -> np.ndarray:
        """Spherical k-means from evenly picked first centres."""
        k = min(CLUSTERS, len(x))
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(12):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.array([(near == j).astype(np.float32) @ x if (near == j).any() else centres[j] for j in range(k)])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        return centres

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        names, scores, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.names:
            return names, scores, rejected
        for i, t in enumerate(texts):
            c = counts(t)
            if c is None:
                continue
            at = np.flatnonzero(c)
            w = np.log1p(c[at]) * self.idf[at]
            cos = (w @ self.matrix[at]) / max(1e-12, float(np.sqrt(w @ w)))
            j = int(cos.argmax())
            names[i], scores[i] = self.names[self.owner[j]], min(1.0, max(0.0, float(cos[j])))
            rejected[i] = scores[i] < self.floor[self.owner[j], _bucket(np.array([c.sum()]))[0]]
        return names, scores, rejected


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, left_out: int = 2) -> Centroids:
    """Learn from about SAMPLE rows with a language whose crc32(id as text) mod ``mod`` is not ``left_out``.

    Each language gives an equal share, picked by a hash of the id, and one row at least. Executors count n-grams; only
    counts reach the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (crc_mod(F.col(id_col), mod) != left_out)).select(F.col(id_col).alias("lid"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    point = F.pmod(F.xxhash64(F.lit(17), "lid"), F.lit(1_000_003))
    sizes = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(point.alias("point"), "lid")).alias("first")), "languages")
    rates = sizes.select(F.col("lang").alias("l2"), (F.lit(float(SAMPLE) / max(1, sizes.count())) / F.col("n")).alias("rate"), F.col("first.lid").alias("first_id"))
    picked = known.join(rates, F.col("lang") == F.col("l2")).where((point < F.col("rate") * 1_000_003) | (F.col("lid") == F.col("first_id")))
    picked = picked.groupBy("lid", "lang").agg(F.min("text").alias("text"))  # one text an id: repeated rows don't stretch the sample

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t.as_py()) for t in b.column(2)]
            at = [None if r is None else np.flatnonzero(r) for r in rows]
            slots = pa.array([None if a is None else a.astype(np.uint16).tobytes() for a in at], pa.binary())
            values = pa.array([None if a is None else r[a].astype(np.uint32).tobytes() for r, a in zip(rows, at, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), slots, values], names=["lid", "lang", "slots", "counts"])

    found = picked.mapInArrow(extract, "lid string, lang string, slots binary, counts binary").where("slots is not null").collect()
    found.sort(key=lambda r: (r["lang"], r["lid"]))
    x = np.zeros((len(found), SLOTS), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["slots"], np.uint16)] = np.log1p(np.frombuffer(r["counts"], np.uint32))
    return Centroids(x, [r["lang"] for r in found])


def detect(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row, whole texts, in one pass without a shuffle.

    Null texts and texts without a letter are ``und``, score 0, rejected; so is everything if nothing could be learned.
    Ties go to the language that sorts first. Null ids and repeated rows stay as they are; an empty table gives an empty
    result. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, rejected = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that are not rejected. Cases as in ``detect``."""
    return keep_rows(docs, text_col, lambda texts: ~model.predict(texts)[2])


def language_id(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``; rows whose crc32(doc_id) mod 4 is 2 are held out of learning."""
    return detect(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
