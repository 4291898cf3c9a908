"""Toxicity by compression distance between a toxic and an ordinary dictionary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample
from .learn import Logistic

#: Labelled documents that the model is fitted on, at most, of each class, and bytes of their texts, of each class too.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 2000, 4000, 24 << 20
#: Words of a window, bytes of the two dictionaries, words of the ordinary training text.
WINDOW_WORDS, ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_WORDS = 16, 65536, 2500, 200_000
#: A training passage counts as toxic by its rarest 5-byte pieces: in at least this share of toxic documents, this much more often than in ordinary ones.
PIECE, PIECE_SHARE, PIECE_RATIO = 5, 0.01, 40


def windows(text: bytes | None) -> list[bytes]:
    """Stretches of WINDOW_WORDS words, in lower case (A-Z); one empty window where there are none."""
    words = (text or b"").lower().split()
    return [b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)] or [b""]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    """Fast strategy with raw literals: a byte found in the dictionary is a byte saved, so lengths measure coverage."""
    params = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_FAST, min_match=6, target_length=1, hash_log=17, chain_log=16, search_log=5, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT))


def _train(words: list[bytes], size: int) -> bytes:
    """Dictionary content that zstandard's trainer picks from ``words``; all of them where they are too few for it."""
    samples = [b" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
    try:
        return zstd.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstd.ZstdError:
        return b" ".join(words)[-size:]


def _pieces(word: bytes) -> Iterator[bytes]:
    for i in range(max(1, len(word) - PIECE + 1)):
        yield word[i : i + PIECE]


@dataclass
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _pair=None)

    def gains(self, text: bytes | None) -> np.ndarray:
        """Bytes saved in each window by knowing toxic text besides ordinary text."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary or b" "), _compressor(self.ordinary + self.toxic or b" ")
        plain, both = self._pair
        ws = windows(text)
        return np.fromiter((len(plain.compress(w)) - len(both.compress(w)) for w in ws), np.float64, len(ws))

    def features(self, text: bytes | None) -> np.ndarray:
        g = self.gains(text)
        top = -np.sort(-g)[:3]
        n = len(g)
        return np.array([g.mean(), top[0], top[:2].mean(), top.mean(), (g >= 2).mean(), (g >= 4).mean(), (g >= 7).mean(), np.log1p((g >= 4).sum()), np.log1p(n)])


def fit_dictionaries(texts: list[bytes], toxic: list[int]) -> Dictionaries:
    """Both dictionaries from labelled texts. Copies count once; passages of toxic texts that ordinary texts share are left out."""
    pieces, sizes, words = (Counter(), Counter()), [0, 0], ([], [])
    for text, y in dict(zip(texts, toxic, strict=True)).items():
        ws = set((text or b"").lower().split())
        sizes[y] += 1
        words[y].append(sorted(ws))
        pieces[y].update({p for w in ws for p in _pieces(w)})
    telling = {p for p, k in pieces[1].items() if k >= max(4, PIECE_SHARE * sizes[1]) and k / sizes[1] > PIECE_RATIO * (pieces[0][p] + 1) / max(1, sizes[0])}
    bad = [w for ws in words[1] for w in ws if any(p in telling for p in _pieces(w))]
    good = [w for ws in words[0] for w in ws]
    rng = np.random.default_rng(7)
    good = [good[i] for i in rng.permutation(len(good))[:ORDINARY_WORDS]]
    bad = [bad[i] for i in rng.permutation(len(bad))]
    return Dictionaries(_train(good, ORDINARY_BYTES), _train(bad, TOXIC_BYTES) if bad else b"")


class Model:
    """Dictionaries and the calibration of window gains into a probability, fitted on documents that the dictionaries haven't seen."""

    def __init__(self, texts: list[bytes], toxic: list[int]):
        part = np.arange(len(texts)) % 3 == 0
        learn = [i for i in range(len(texts)) if not part[i]] or list(range(len(texts)))
        check = [i for i in range(len(texts)) if part[i]] or list(range(len(texts)))
        self.dictionaries = fit_dictionaries([texts[i] for i in learn], [toxic[i] for i in learn])
        x = np.array([self.dictionaries.features(texts[i]) for i in check]).reshape(len(check), 9)
        self.calibration = Logistic(x, np.array([toxic[i] for i in check], float))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.calibration(np.array([self.dictionaries.features(t) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 5, left_out: int = 0) -> Model:
    """Learn from a bounded sample of rows with a 0/1 label whose crc32(id as text) mod ``mod`` is not ``left_out``; documents beyond SAMPLE_BYTES of their class are left out."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, mod, left_out, {1: SAMPLE_TOXIC, 0: SAMPLE_ORDINARY}, F.octet_length("text"), SAMPLE_BYTES, 11, "toxicity-sample")
    rows = [(r["lid"], (r["text"] or "").encode(), r["y"]) for r in sample.collect()]
    rows.sort()
    order = np.random.default_rng(3).permutation(len(rows))
    return Model([rows[i][1] for i in order], [rows[i][2] for i in order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, whole texts, in one pass without a shuffle.

    Null and empty texts are one empty window and get the score of a document without toxic windows. Null ids and
    repeated rows stay as they are; an empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; rows whose crc32(doc_id) mod 5 is 0 are held out of learning."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
