"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, keep_rows, labelled_sample
from .learn import Logistic

#: Labelled documents of each class that the field is fitted on, and lines of them, at most.
SAMPLE_DOCS, SAMPLE_LINES = 2000, 400_000
#: Characters that one vectorised step takes (a longer document is a step of its own).
STEP_CHARS = 1_000_000
#: Gradient steps before and in each round of the fit, rounds, and weights of the quadratic penalty: of a line's own features, of its neighbours' and of moves.
FIRST_STEPS, ROUND_STEPS, ROUNDS, RIDGE, RIDGE_AROUND = 60, 25, 6, 1e-4, 3e-3
#: What a label says of a document's lines, by length: a good one has this share of good lines at least, a bad one at most.
GOOD_SHARE, BAD_SHARE = 0.9, 0.5
#: Unlabelled lines are taken for this much surer than they are, so that rounds settle them.
SURER = 1.5

#: Character classes: fixed values.
_OTHER, _UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _COMMA, _BANG, _BAR, _MARK, _HIGH, _NEWLINE = range(12)
_CLASSES = 12


def _class_table() -> np.ndarray:
    table = np.full(0x110000, _HIGH, np.uint8)
    table[:128] = _OTHER
    for i in range(0x250):
        c = chr(i)
        if c.isupper():
            table[i] = _UPPER
        elif c.islower():
            table[i] = _LOWER
        elif c.isdigit():
            table[i] = _DIGIT
        elif c.isspace():
            table[i] = _SPACE
    for chars, kind in ((".?:;", _STOP), (",'\"()-", _COMMA), ("!", _BANG), ("|", _BAR), ("*$%&#@^~=<>{}[]\\/+_`", _MARK), ("\n", _NEWLINE)):
        for c in chars:
            table[ord(c)] = kind
    return table


_table: np.ndarray | None = None
#: Features of a line itself; those of the line before and after follow, then two flags for the ends of the document.
OWN = 18
FEATURES = 3 * OWN + 3


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines of ``texts``, the number of lines of each text, and the characters of each line.

    A null or empty text is one empty line.
    """
    global _table
    if _table is None:
        _table = _class_table()
    texts = [t or "" for t in texts]
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    kinds = _table[code]
    ends = kinds == _NEWLINE
    line_of = np.cumsum(ends) - ends
    n = int(ends.sum()) + 1
    counts = np.bincount(line_of * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float64)
    counts[:, _NEWLINE] = 0
    size = counts.sum(axis=1)
    per_doc, words, fresh, again, tail = [], np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    i = 0
    for t in texts:
        lines = t.split("\n")
        seen = Counter(lines)
        per_doc.append(len(lines))
        for line in lines:
            ws = line.split()
            words[i], fresh[i], again[i] = len(ws), len(set(ws)), seen[line]
            tail[i] = line.rstrip()[-1:] in {".", "!", "?", '"'}
            i += 1
    per_doc = np.array(per_doc, np.int64)
    full = np.maximum(size, 1.0)[:, None]
    letters = np.maximum(counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _HIGH], 1.0)
    w = np.maximum(words, 1.0)
    own = np.column_stack([
        np.log1p(size) / 5, np.log1p(words) / 4, counts[:, _UPPER] / letters, (counts[:, [_DIGIT, _STOP, _COMMA, _SPACE]] / full) * 3,
        np.minimum(counts[:, [_BANG, _BAR, _MARK]] / w[:, None], 2.0), counts[:, _OTHER] / full[:, 0], counts[:, _HIGH] / full[:, 0],
        np.minimum(size / w, 30.0) / 10, fresh / w, np.log1p(w) * (1 - fresh / w), (again > 1) * 1.0, np.log1p(again) / 3, tail,
    ])
    first = np.cumsum(per_doc) - per_doc
    last = first + per_doc - 1
    prev, nxt = np.zeros_like(own), np.zeros_like(own)
    prev[1:], nxt[:-1] = own[:-1], own[1:]
    prev[first], nxt[last] = 0, 0
    flags = np.zeros((n, 3))
    flags[first, 0], flags[last, 1], flags[:, 2] = 1, 1, 1
    return np.hstack([own, prev, nxt, flags]), per_doc, size


def _padded(per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling length, the first line of each, and how many of them reach each step."""
    order = np.argsort(-per_doc, kind="stable")
    first = (np.cumsum(per_doc) - per_doc)[order]
    alive = len(per_doc) - np.searchsorted(np.sort(per_doc), np.arange(per_doc.max() if len(per_doc) else 0), side="right")
    return order, first, per_doc[order], alive


def forward_backward(score: np.ndarray, trans: np.ndarray, per_doc: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the two states at every line, and expected transitions summed over all chains, weighted by ``share`` of each line."""
    _, first, _, alive = _padded(per_doc)
    n = len(score)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    for t, k in enumerate(alive):
        at = first[:k] + t
        if t == 0:
            fwd[at] = score[at]
        else:
            p = fwd[at - 1]
            fwd[at] = score[at] + np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        nx = bwd[at + 1] + score[at + 1]
        bwd[at] = np.logaddexp(trans[:, 0] + nx[:, :1], trans[:, 1] + nx[:, 1:])
    both = fwd + bwd
    whole = np.logaddexp(both[:, 0], both[:, 1])
    marginal = np.exp(both - whole[:, None])
    if share is None:
        return marginal, np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pair = np.exp(fwd[at - 1][:, :, None] + trans[None] + (score[at] + bwd[at])[:, None, :] - whole[at][:, None, None])
    return marginal, (pair * share[at][:, None, None]).sum(axis=0)


class Field:
    """A two-state chain: emission weights, transitions, and the calibration from a document's mean marginal to its label.

    Lines have no labels: their states are latent, and a document's label only bounds the share of its good lines. The first
    steps look at each line alone, under its document's label. Each round then takes the field's own line marginals and
    pairs, moved just as far as the labels demand, as what the next steps aim at. So a clean line of a bad document is free
    to be good, and a bad line of a good one to be bad.
    """

    def __init__(self, x: np.ndarray, per_doc: np.ndarray, chars: np.ndarray, y: np.ndarray):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.mean[-3:], self.scale[-3:] = 0, 1
        self.w, self.trans = np.zeros((FEATURES, 2)), np.zeros((2, 2))
        self.calibration = None
        if not len(y):
            return
        z = (x - self.mean) / self.scale
        # Each document and each class weighs alike.
        of_doc = (0.5 / np.maximum(1, np.bincount(y, minlength=2)))[y]
        share = np.repeat(of_doc / per_doc, per_doc)
        alone = np.r_[np.ones(OWN), np.zeros(2 * OWN), np.zeros(2), 1.0][:, None]
        gold = np.zeros((len(z), 2))
        gold[np.arange(len(z)), np.repeat(y, per_doc)] = 1
        self._climb(z, per_doc, share, gold, None, FIRST_STEPS, alone)
        for _ in range(ROUNDS):
            gold, pairs = self._allowed(z, per_doc, chars, y, share)
            self._climb(z, per_doc, share, gold, pairs, ROUND_STEPS, np.ones_like(alone))
        self.calibration = Logistic(self._raw(z, per_doc, chars), y.astype(float))

    def _climb(self, z: np.ndarray, per_doc: np.ndarray, share: np.ndarray, gold: np.ndarray, pairs: np.ndarray | None, steps: int, mask: np.ndarray) -> None:
        """Gradient steps towards line states ``gold`` and summed ``pairs`` (None: lines stand alone)."""
        ridge = np.r_[np.full(OWN, RIDGE), np.full(2 * OWN, RIDGE_AROUND), np.full(3, RIDGE)][:, None]
        m1, m2 = [np.zeros_like(self.w), np.zeros_like(self.trans)], [np.zeros_like(self.w), np.zeros_like(self.trans)]
        for step in range(1, steps + 1):
            marginal, pair = forward_backward(z @ self.w, self.trans, per_doc, share)
            grads = [(z.T @ ((marginal - gold) * share[:, None]) + ridge * self.w) * mask, (pair - pairs if pairs is not None else 0 * pair) + RIDGE * self.trans]
            for p, g, a, b in zip((self.w, self.trans), grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= 0.08 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def _allowed(self, z: np.ndarray, per_doc: np.ndarray, chars: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The field's line marginals and pairs, tilted in each document just as far as its label demands (the nearest chain that meets it)."""
        first = np.cumsum(per_doc) - per_doc
        weight = chars + 1.0
        weight /= np.repeat(np.add.reduceat(weight, first), per_doc)
        score, sign = SURER * (z @ self.w), np.where(y == 1, 1.0, -1.0)
        scale = weight * np.repeat(per_doc * sign, per_doc)
        bound = np.where(y == 1, GOOD_SHARE, BAD_SHARE)

        def tilted(tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            moved = score.copy()
            moved[:, 1] += np.repeat(tilt, per_doc) * scale
            return forward_backward(moved, self.trans, per_doc, share)

        def meets(marginal: np.ndarray) -> np.ndarray:
            return (np.add.reduceat(marginal[:, 1] * weight, first) - bound) * sign >= -1e-3

        marginal, pairs = tilted(np.zeros(len(y)))
        low, high = np.zeros(len(y)), np.where(meets(marginal), 0.0, 40.0)
        if not high.any():
            return marginal, pairs
        for _ in range(10):
            middle = (low + high) / 2
            ok = meets(tilted(middle)[0])
            low, high = np.where(ok, low, middle), np.where(ok, middle, high)
        return tilted(high)

    def marginals(self, x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Probability of state 1 (good) at every line."""
        return forward_backward(((x - self.mean) / self.scale) @ self.w, self.trans, per_doc)[0][:, 1]

    def _raw(self, z: np.ndarray, per_doc: np.ndarray, chars: np.ndarray) -> np.ndarray:
        good = forward_backward(z @ self.w, self.trans, per_doc)[0][:, 1]
        first = np.cumsum(per_doc) - per_doc
        weight = chars + 1.0
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.column_stack([np.log(mean / (1 - mean)), mean])

    def in_steps(self, texts: list[str | None]) -> np.ndarray:
        """``scores`` by stretches of about STEP_CHARS characters, so that a batch of long texts stays within memory."""
        out = np.zeros(len(texts))
        for i, j in chunks(len(texts), [len(t or "") for t in texts], STEP_CHARS):
            out[i:j] = self.scores(texts[i:j])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, per_doc, chars = line_features(texts)
        if self.calibration is None:
            return np.full(len(texts), 0.5)
        return self.calibration(self._raw((x - self.mean) / self.scale, per_doc, chars))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 5, left_out: int = 0) -> Field:
    """Fit on a bounded sample of rows with a 0/1 label whose crc32(id as text) mod ``mod`` is not ``left_out``.

    SAMPLE_DOCS documents of each class, in order of a hash of the id; those beyond SAMPLE_LINES / 2 lines of their class
    are left out before their lines are looked at. Executors turn texts into feature rows; only those come to the driver.
    """
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, mod, left_out, {0: SAMPLE_DOCS, 1: SAMPLE_DOCS}, lines, SAMPLE_LINES // 2, 5, "quality-sample")
    kind = docs.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ys = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, t in enumerate(b.column(1)):
                x, per_doc, chars = line_features([t.as_py()])
                feats = np.hstack([x, chars[:, None]]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]], b.column(0).type), pa.array([ys[i]], pa.int32()), pa.array(per_doc.astype(np.int32)), pa.array([feats], pa.binary())], names=["lid", "y", "n", "feats"])

    rows = sample.select("lid", "text", "y").mapInArrow(extract, f"lid {kind}, y int, n int, feats binary").collect()
    rows.sort(key=lambda r: (r["lid"], r["y"], r["feats"]))
    if not rows:
        return Field(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    x = np.vstack([np.frombuffer(r["feats"], np.float32).reshape(r["n"], FEATURES + 1) for r in rows]).astype(np.float64)
    return Field(x[:, :-1], np.array([r["n"] for r in rows], np.int64), x[:, -1], np.array([r["y"] for r in rows], np.int64))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, whole texts, in one pass without a shuffle.

    A null or empty text is one empty line, scored like any other. Null ids and repeated rows stay as they are; an empty
    table gives an empty result. Other columns are ignored. Without labelled rows every score is 0.5.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(field.in_steps(b.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, field: Field, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that score ``threshold`` or more. Cases as in ``score``."""
    return keep_rows(docs, text_col, lambda texts: field.in_steps(texts) >= threshold)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; rows whose crc32(doc_id) mod 5 is 0 are held out of learning."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
