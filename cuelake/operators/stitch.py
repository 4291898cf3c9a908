"""Overlapping transcript chunks to one sequence, and the choice among attempts at a chunk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import has_repetition
from ..functions.text import count_words, match_key
from . import edit
from .joins import best_shift
from .metrics import dense_transcript


def stitch(rows: DataFrame, overlap_ms: int = 10_000) -> DataFrame:
    """One sequence of ``rows(media_id, chunk_idx, pos, start_ms, end_ms, text)`` with times from the start of the media.

    At each boundary of neighbouring chunks (empty ones aside) the words of the overlap are aligned and both sides are cut in
    the middle of the match; without a match the left chunk ends where the right one starts. Boundaries are independent, which
    equals stitching from left to right as long as chunks are longer than two overlaps.
    """
    key = match_key("text")
    # Keys go along only where they aren't the text itself.
    r = rows.select("media_id", "chunk_idx", "pos", "start_ms", "end_ms", "text", F.when(key != F.col("text"), key).alias("key"))

    def f(g: edit.Group) -> list:
        start, end, text = g["start_ms"].tolist(), g["end_ms"].tolist(), g["text"].tolist()
        keys = [t if k is None else k for t, k in zip(text, g["key"].tolist(), strict=True)]
        edges = [0, *(np.flatnonzero(np.diff(g["chunk_idx"])) + 1).tolist(), len(text)]
        chunks = list(zip(edges, edges[1:], strict=False))
        kept, since = [], 0
        for n, (a, b) in enumerate(chunks):
            upto, following = b, 0
            if n + 1 < len(chunks):
                c = chunks[n + 1][1]
                late, early = max(end[a:b]) - overlap_ms, min(start[b:c]) + overlap_ms
                over = [i for i in range(a, b) if start[i] >= late]
                upon = next((i for i in range(b, c) if end[i] > early), c)
                left, right = len(over), upon - b
                if left and right:
                    best = best_shift([(i, keys[x]) for i, x in enumerate(over)], [(x - b, keys[x]) for x in range(b, upon)], left)
                    if best:
                        i = best[0]
                        upto = b - left + (max(0, left - i) + min(left, left + right - i)) // 2
                        following = (max(0, i - left) + min(right, i)) // 2
                    else:
                        upto = max((i + 1 for i in range(a, b) if end[i] <= start[b]), default=b)
            kept += range(a + since, upto)
            since = following
        return [[g["media_id"][0]] * len(kept), range(len(kept)), *([x[i] for i in kept] for x in (start, end, text))]

    kind = rows.schema["media_id"].dataType.simpleString()
    return edit.per_key(edit.spread(r, "media_id").sortWithinPartitions("media_id", "chunk_idx", "pos"), ["media_id"], f, f"media_id {kind}, cue_idx int, start_ms long, end_ms long, text string")


def transcript_verdict(transcripts: DataFrame) -> DataFrame:
    """``verdict`` of ``(text, duration_ms)``: dense, repetitive (a phrase eight times in a row or more), or ok."""
    v = F.when(dense_transcript(F.col("text"), F.col("duration_ms")), "dense").when(has_repetition("text", F.lit(8)), "repetitive").otherwise("ok")
    return transcripts.withColumn("verdict", v)


def accept_attempts(attempts: DataFrame) -> DataFrame:
    """Per chunk the first acceptable of ``attempts(media_id, chunk_idx, attempt, parts, text, duration_ms, problems)``.

    The order is: first try, retry, two parts, three parts; where none is acceptable the last one stands, marked estimated.
    """
    a = transcript_verdict(attempts)
    good = (F.col("verdict") == "ok") & (F.size(F.coalesce("problems", F.array().cast("array<string>"))) == 0) & (count_words("text") > 0)
    order = F.struct((~good).alias("bad"), F.when(good, F.col("parts")).otherwise(-F.col("parts")).alias("p"), F.when(good, F.col("attempt")).otherwise(-F.col("attempt")).alias("t"))
    best = F.min_by(F.struct("attempt", "parts", "text", "verdict", (~good).alias("estimated")), order)
    return a.groupBy("media_id", "chunk_idx").agg(best.alias("b")).select("media_id", "chunk_idx", "b.*")
