"""Operators whose next step depends on the last: ordered cues at a time.

What forgets all at a long gap runs in ``applyInPandas`` over bundles of runs between such gaps, which windows number; the
rest over whole media items, which hold thousands of cues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..cues import in_order, lag
from ..functions.text import NO_SPACE, count_of, count_words, estimate_tokens, mainly_cjk, once, reading_load, squeeze, strip
from ..policy import SpeedPolicy
from ..storage import keep
from .windows import MUSIC, with_protection, with_rhythm

#: Words that leave a line hanging, and words that open or close a clause.
WEAK_ENDS = frozenset("a an the to of in on at for from with about into onto by as than and or but if because that this these those".split())
CLAUSE_OPENERS = ("and", "or", "but", "if", "then", "because", "as", "until", "while", "what", "when", "where", "nor", "yet", "so", "for", "however", "moreover", *"和及与但而或因我你他她它咱您这那哪")
CLAUSE_CLOSERS = (".", ",", "!", "?", "。", "，", "！", "？", *"的了着过吗呢吧啊呀嘛啦", "mine", "yours", "hers", "its", "ours", "theirs", "either", "neither")
LIMIT_CJK, LIMIT_WORDS = 25, 18


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over twice as many tasks as ``spark.sql.shuffle.partitions`` says.

    Spark joins small partitions by their bytes, which say little of how long a Python step takes; these stay as they are. Of
    as many tasks as before by the same keys, Spark would leave the step out.
    """
    return rows.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


Group = dict[str, np.ndarray]


def per_key(rows: DataFrame, keys: list[str], f: Callable[[Group], list], schema: str) -> DataFrame:
    """``f`` over the columns, as arrays, of each stretch of rows with equal ``keys``; it returns the columns of ``schema`` as lists or arrays.

    Each key's rows must lie in one partition and together. A task cuts its batches where the key changes and carries the last
    stretch over, so many small groups cost one pass, not a group each. Nulls are NaN in columns of numbers, None in keys.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        last: tuple | None = None

        def arrays(t: pa.Table | pa.RecordBatch, names: list[str]) -> Group:
            # Keys that may be null are compared as objects.
            return {n: np.array([*t.column(n).to_pylist(), None], object)[:-1] if n in keys and t.column(n).null_count else np.asarray(t.column(n).to_numpy(**({} if isinstance(t, pa.Table) else {"zero_copy_only": False}))) for n in names}

        def begins(cols: Group) -> np.ndarray:
            return np.flatnonzero(np.r_[True, np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)])

        def folded(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = arrays(t, t.column_names)
            first = begins(cols).tolist()
            out: list[list] = [[] for _ in kinds.names]
            for a, b in zip(first, [*first[1:], t.num_rows], strict=True):
                for column, new in zip(out, f({n: c[a:b] for n, c in cols.items()}), strict=True):
                    column.extend(new)
                if len(out[0]) >= 20_000 or b == t.num_rows:
                    for at in range(0, len(out[0]), 20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000], k, from_pandas=True) for c, k in zip(out, kinds.types, strict=True)], schema=kinds)
                    out = [[] for _ in kinds.names]

        for b in batches:
            if not b.num_rows:
                continue
            cols = arrays(b, keys)
            first = begins(cols)
            if left and last == tuple(cols[k][0] for k in keys):
                first = first[1:]
            last = tuple(cols[k][-1] for k in keys)
            if len(first):
                if left or first[-1]:
                    yield from folded(pa.Table.from_batches([*left, b.slice(0, first[-1])]))
                left = []
                b = b.slice(first[-1])
            left.append(b)
        if left:
            yield from folded(pa.Table.from_batches(left))

    return rows.mapInArrow(run, schema)


def packed(rows: DataFrame, keys: list[str], *steps: str) -> DataFrame:
    """``rows`` that follow each other with equal ``keys`` as one row, with a list of each other column.

    Many small rows are shuffled and sorted as few; a key may have several of them. Whole numbers ``steps``, which are never
    null, are given as steps from the one before, the first as it is: small numbers take less room.
    """
    others = [c for c in rows.columns if c not in keys]
    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in others])
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = [np.array([*b.column(k).to_pylist(), None], object)[:-1] if b.column(k).null_count else b.column(k).to_numpy(zero_copy_only=False) for k in keys]
                first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
                ends = pa.array(np.r_[first, b.num_rows], pa.int32())

                def stepwise(v: pa.Array, first: np.ndarray = first) -> pa.Array:
                    n = v.to_numpy()
                    step = np.diff(n, prepend=n[:1])
                    step[first] = n[first]
                    return pa.array(step)

                lists = [pa.ListArray.from_arrays(ends, stepwise(b.column(c)) if c in steps else b.column(c), type=kinds.field(c).type) for c in others]
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(first)) for k in keys] + lists, schema=kinds)

    return rows.select(*keys, *others).mapInArrow(run, schema)


def per_segment(rows: DataFrame, f: Callable[[Group], list], schema: str) -> DataFrame:
    """``per_key`` by media item."""
    return per_key(rows, ["media_id"], f, schema)


def per_media(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` over the ordered cues of each media item, as pandas."""
    return spread(rows, "media_id").groupBy("media_id").applyInPandas(lambda g: f(g.sort_values(["start_ms", "cue_idx"], kind="stable").reset_index(drop=True)), schema)


def per_item(rows: DataFrame, f: Callable[[Group], list], schema: str) -> DataFrame:
    """``f`` over the ordered cues of each media item, as arrays; a fold over many items a task."""
    return per_key(spread(rows, "media_id").sortWithinPartitions("media_id", "start_ms", "cue_idx"), ["media_id"], f, schema)


def per_two(left: DataFrame, right: DataFrame, f: Callable[[object, Group, Group], list], schema: str) -> DataFrame:
    """``f(media_id, rows of left, rows of right)`` for each media item of either table; the first of the columns given after ``media_id`` orders its rows.

    Both tables go through one shuffle as one. Numbers must not be null.
    """
    sides = [[c for c in t.columns if c != "media_id"] for t in (left, right)]

    def side(t: DataFrame, k: int) -> DataFrame:
        return t.select("media_id", F.lit(k).alias("side__"), *[F.col(c).alias(f"{k}_{c}") for c in sides[k]])

    both = side(left, 0).unionByName(side(right, 1), allowMissingColumns=True)
    numbers = {n: 0 for n, kind in both.dtypes if kind in ("int", "bigint", "double") and n not in ("media_id", "side__")}
    both = spread(both.na.fill(numbers), "media_id").sortWithinPartitions("media_id", "side__", f"0_{sides[0][0]}", f"1_{sides[1][0]}", f"0_{sides[0][1]}", f"1_{sides[1][1]}")

    def g(rows: Group) -> list:
        cut = int(np.searchsorted(rows["side__"], 1))
        parts = ({c: rows[f"{k}_{c}"][at] for c in sides[k]} for k, at in ((0, slice(0, cut)), (1, slice(cut, None))))
        return f(rows["media_id"][0], *parts)

    return per_key(both, ["media_id"], g, schema)


#: Ordered cues that a group takes before it ends with a run.
BUNDLE = 5000


def per_run(rows: DataFrame, breaks: Column, f: Callable[[Group], list], schema: str) -> DataFrame:
    """``f`` over bundles of whole runs of a media item's ordered cues; a run begins where ``breaks`` holds, and ``f`` must forget all there.

    A bundle holds BUNDLE cues and the rest of a run, so usual media items are one group, and long ones many, which go to different tasks.
    """
    place = F.row_number().over(in_order())
    first = F.last(F.when(F.coalesce("breaks__", F.lit(False)) | (F.col("place__") == 1), F.col("place__")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    bundles = rows.withColumn("breaks__", breaks).withColumn("place__", place).withColumn("bundle__", F.floor(first / BUNDLE)).drop("breaks__", "place__")
    return per_key(spread(bundles, "media_id", "bundle__").sortWithinPartitions("media_id", "bundle__", "start_ms", "cue_idx"), ["media_id", "bundle__"], f, schema)


def _gap() -> Column:
    return F.col("start_ms") - lag("end_ms")


def _numbered(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``rows`` with their place in the media item, from 0."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy("media_id").orderBy(*order)) - 1).cast("int"))


def _cuts(start: np.ndarray, end: np.ndarray, max_gap: int, usual: bool = True) -> list[int]:
    """Where groups begin: after a gap over ``max_gap``, or one over three times the mean of the last five in a group of more than five."""
    cuts, recent, size = [0], [], 1
    start, end = start.tolist(), end.tolist()
    for i in range(1, len(start)):
        gap = start[i] - end[i - 1]
        recent = [*recent[-4:], gap]
        wide = usual and len(recent) == 5 and size > 5 and gap > 3 * sum(recent) / 5
        if wide or gap > max_gap:
            cuts.append(i)
            recent, size = [], 0
        size += 1
    return cuts


def adaptive_groups(cues: DataFrame, max_gap_ms: int = 1500) -> DataFrame:
    """``(media_id, cue_idx, group_no)``: groups by gap, with extra cuts where a gap stands out among the last five."""

    def f(g: Group) -> list:
        marks = np.zeros(len(g["cue_idx"]), int)
        marks[_cuts(g["start_ms"], g["end_ms"], max_gap_ms)] = 1
        return [g["media_id"], g["cue_idx"], g["start_ms"], marks]

    marked = per_run(cues.select("media_id", "cue_idx", "start_ms", "end_ms"), _gap() > max_gap_ms, f, "media_id long, cue_idx int, start_ms long, begins int")
    return marked.select("media_id", "cue_idx", (F.sum("begins").over(in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int").alias("group_no"))


def _measured(cues: DataFrame) -> DataFrame:
    return cues.withColumn("words", count_words("text")).withColumn("cjk", mainly_cjk("text"))


_CUE = "media_id long, cue_idx int, start_ms long, end_ms long, text string, first_idx int, last_idx int"


def merge_short(cues: DataFrame) -> DataFrame:
    """Neighbours joined, from the left and again with what they became, while one is short, the gap is small and the sum fits a line."""

    def f(g: Group) -> list:
        out: list[list] = []
        for idx, start, end, text, words, cjk in zip(*(g[c].tolist() for c in ("cue_idx", "start_ms", "end_ms", "text", "words", "cjk")), strict=True):
            if out:
                p = out[-1]
                gap, least, fits = abs(start - p[1]), min(p[3], words), p[3] + words <= (LIMIT_CJK if p[4] else LIMIT_WORDS)
                if fits and ((gap < 200 and least < 5) or (gap < 500 and least < 3)):
                    p[1], p[2], p[3], p[6] = end, p[2] + ("" if p[4] else " ") + text, p[3] + words, idx
                    continue
            out.append([start, end, text, words, cjk, idx, idx])
        start, end, text, _, _, first, last = zip(*out, strict=True)
        return [[g["media_id"][0]] * len(out), start, end, text, first, last]

    joined = per_run(_measured(cues).select("media_id", "cue_idx", "start_ms", "end_ms", "text", "words", "cjk"), F.abs(_gap()) >= 500, f, _CUE.replace("cue_idx int, ", ""))
    return _numbered(joined, "cue_idx", ["start_ms", "first_idx"]).select("media_id", "cue_idx", "start_ms", "end_ms", "text", "first_idx", "last_idx")


def _clauses(texts: list[str], cjk: list[bool], a: int, b: int) -> Iterator[tuple[int, int]]:
    """Cut [a, b) before clause openers and after clause closers, once a group is long enough for it."""
    first = a
    for i in range(a, b):
        limit, size = (LIMIT_CJK if cjk[i] else LIMIT_WORDS), i - first
        if size and texts[i].lower().startswith(CLAUSE_OPENERS) and size >= int(limit * 0.6):
            yield first, i
            first, size = i, 0
        if i > a and size and texts[i - 1].lower().endswith(CLAUSE_CLOSERS) and size >= int(limit * 0.4):
            yield first, i
            first = i
    yield first, b


def _halves(firm: np.ndarray, gap: np.ndarray, words: np.ndarray, cjk_part: Callable[[int, int], bool], a: int, b: int) -> Iterator[tuple[int, int]]:
    """Halve [a, b) at the best boundary of its middle until the parts fit a line: the widest gap, after a firm word, nearest the middle, first."""
    n = b - a
    if words[a:b].sum() <= (LIMIT_CJK if cjk_part(a, b) else LIMIT_WORDS) or n < 4:
        yield a, b
        return
    cut = n // 2
    at = np.arange(a + max(n // 6, 1), a + min(5 * n // 6, n - 2))
    if len(at):
        at = at[gap[at] == gap[at].max()]
        at = at[firm[at] == firm[at].max()]
        cut = int(at[np.abs(at - a - (n - 1) / 2).argmin()]) - a
    yield from _halves(firm, gap, words, cjk_part, a, a + cut + 1)
    yield from _halves(firm, gap, words, cjk_part, a + cut + 1, b)


class Words:
    """Measured word cues of one media item, in order, and the lines that stretches [a, b) of them make."""

    def __init__(self, g: Group):
        self.texts, self.start, self.end = g["text"].tolist(), g["start_ms"], g["end_ms"]
        self.n_words, self.cjk = g["words"], g["cjk"].tolist()
        self.visible, self.letters = (np.concatenate(([0], np.cumsum(g[c]))) for c in ("visible", "letters"))
        self.gap = self.start[1:] - self.end[:-1]
        self.firm = np.array([t.strip().lower().strip(".,!?;:\"'()[]{}，。！？；：、") not in WEAK_ENDS for t in self.texts])

    def _cjk_part(self, a: int, b: int) -> bool:
        return (self.letters[b] - self.letters[a]) * 2 > self.visible[b] - self.visible[a]

    def halved(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Parts of [a, b) that fit a line."""
        return _halves(self.firm, self.gap, self.n_words, self._cjk_part, a, b)

    def by_gaps(self, a: int, b: int, max_gap: int, usual: bool = False) -> list[tuple[int, int]]:
        edges = [*(a + np.array(_cuts(self.start[a:b], self.end[a:b], max_gap, usual))).tolist(), b]
        return list(zip(edges, edges[1:], strict=False))

    def by_rules(self, a: int, b: int) -> list[tuple[int, int]]:
        """Groups by gap, clauses of long groups, then halves of what is still too long; in order."""
        spans: list[tuple[int, int]] = []
        for c, d in self.by_gaps(a, b, 500, True) if b > a else []:
            long = self.n_words[c:d].sum() > (LIMIT_CJK if self._cjk_part(c, d) else LIMIT_WORDS)
            for x, y in _clauses(self.texts, self.cjk, c, d) if long else [(c, d)]:
                spans += self.halved(x, y)
        return sorted(spans)


def measured_words(words: DataFrame) -> DataFrame:
    """What ``Words`` needs of each word cue."""
    w = _measured(words).withColumn("visible", F.length(squeeze("text"))).withColumn("letters", F.regexp_count("text", F.lit(NO_SPACE)))
    return w.select("media_id", "cue_idx", "start_ms", "end_ms", "text", "words", "cjk", "visible", "letters")


def segment(words: DataFrame) -> DataFrame:
    """Word cues to line cues by rules: groups by gap, clauses of long groups, then halves of what is still too long."""

    def f(g: Group) -> list:
        key, g = g["media_id"][0], {c: np.concatenate(parts) for c, parts in g.items() if c != "media_id"}
        order = np.lexsort((g["cue_idx"], g["start_ms"]))
        g = {c: v[order] for c, v in g.items()}
        w, idx = Words(g), g["cue_idx"]
        first, last = np.array(w.by_rules(0, len(idx))).T
        return [[key] * len(first), w.start[first], w.end[last - 1], ["".join(w.texts[a:b]).strip() for a, b in zip(first.tolist(), last.tolist(), strict=True)], idx[first], idx[last - 1]]

    # Lists of words take less room than rows, and are put in order in the fold.
    lists = packed(measured_words(words), ["media_id"])
    lines = per_segment(spread(lists, "media_id").sortWithinPartitions("media_id"), f, _CUE.replace("cue_idx int, ", ""))
    return _numbered(lines, "cue_idx", ["start_ms", "first_idx"]).select("media_id", "cue_idx", "start_ms", "end_ms", "text", "first_idx", "last_idx")


def alignment_windows(cues: DataFrame, target_ms: int = 45_000, most_ms: int = 90_000, reset_ms: int = 1500, pad_ms: int = 1500) -> DataFrame:
    """``(media_id, window_no, first_idx, last_idx, cue_start_ms, cue_end_ms, clip_start_ms, clip_end_ms)``: runs between long pauses, cut near the target length.

    Of cuts equally near it the one at the wider gap wins, then the earlier.
    """

    def f(g: Group) -> list:
        s, e, idx = g["start_ms"], g["end_ms"], g["cue_idx"].tolist()
        resets = [0, *(np.flatnonzero(s[1:] - e[:-1] >= reset_ms) + 1).tolist(), len(idx)]
        s, e, rows = s.tolist(), e.tolist(), []
        for a, n in zip(resets, resets[1:], strict=False):
            while a < n:
                last, options = a, []
                for i in range(a, n):
                    span = e[i] - s[a]
                    if span > most_ms and i > a:
                        break
                    last = i
                    if i < n - 1:
                        options.append((abs(span - target_ms), -(s[i + 1] - e[i]), i))
                    if span >= target_ms:
                        break
                cut = last if last == n - 1 or not options else min(options)[2]
                rows.append((g["media_id"][0], idx[a], idx[cut], s[a], e[cut], max(0, s[a] - pad_ms), e[cut] + pad_ms))
                a = cut + 1
        return list(zip(*rows, strict=True))

    c = cues.where((F.length(strip("text")) > 0) & (F.col("end_ms") > F.col("start_ms"))).select("media_id", "cue_idx", "start_ms", "end_ms")
    out = per_run(c, _gap() >= reset_ms, f, "media_id long, first_idx int, last_idx int, cue_start_ms long, cue_end_ms long, clip_start_ms long, clip_end_ms long")
    return _numbered(out, "window_no", ["cue_start_ms", "first_idx"]).select("media_id", "window_no", "first_idx", "last_idx", "cue_start_ms", "cue_end_ms", "clip_start_ms", "clip_end_ms")


def _json_costs(cues: DataFrame, *also: str) -> DataFrame:
    """ASCII and other characters of each cue's ``{"id":..,"text":..}``: payload costs are sums of these."""
    j = F.to_json(F.struct(F.col("cue_idx").cast("string").alias("id"), F.col("text").alias("text")))
    n = once(j, lambda x: F.struct(F.length(x).alias("all"), count_of(x, r"[^\x00-\x7F]").alias("other")))
    return cues.select("media_id", "cue_idx", "start_ms", *also, n.alias("n")).select("media_id", "cue_idx", "start_ms", *also, (F.col("n.all") - F.col("n.other")).alias("plain"), F.col("n.other").alias("other"))


def _tokens(plain: int, other: int) -> int:
    return max(1, -(-int(plain) // 3) + int(other))


_PLAN = "media_id long, window_no int, before_idx int, first_idx int, last_idx int, after_idx int, tokens int, problem string"


def analysis_windows(cues: DataFrame, budget: int = 4000, fixed: int = 500, reserve: int = 500, overlap: int = 2) -> DataFrame:
    """Windows as long as the token budget allows that share ``overlap`` cues. A cue that fits none makes a row with ``problem``; the next window begins after it."""

    def f(g: Group) -> list:
        p, o, idx, room = g["plain"].tolist(), g["other"].tolist(), g["cue_idx"].tolist(), budget - fixed - reserve
        rows, a, n = [], 0, len(idx)
        while a < n:
            b, plain, other, cost = a, 1, 0, 0
            while b < n and _tokens(plain + p[b] + 1, other + o[b]) <= room:
                plain, other = plain + p[b] + 1, other + o[b]
                cost, b = _tokens(plain, other), b + 1
            if b == a:
                rows.append((idx[a],) * 4 + (fixed + _tokens(plain + p[a] + 1, other + o[a]), "over_budget"))
                a += 1
                continue
            rows.append((idx[a], idx[a], idx[b - 1], idx[b - 1], fixed + cost, None))
            if b >= n:
                break
            # No window spans a cue that fits none.
            a = max(a + 1, b - min(overlap, b - a - 1)) if _tokens(p[b] + 2, o[b]) <= room else b
        return [[g["media_id"][0]] * len(rows), range(len(rows)), *zip(*rows, strict=True)]

    return per_item(_json_costs(cues), f, _PLAN)


def _batch_bounds(g: Group, size: int, budget: int, fixed: int, reserve: int, radius: int) -> list[tuple]:
    """``(before, first, last, after, tokens, problem)`` of each batch of a media item's ordered cues, by their places."""
    shell = len('{"boundary_context":{"before":[],"after":[]},"translation_subjects":[]}')
    cp, co = ([0, *g[c].cumsum().tolist()] for c in ("plain", "other"))
    n = len(g["plain"])

    def cost(a: int, k: int, r: int) -> int:
        lists = ((max(0, a - r), a), (a, a + k), (a + k, min(n, a + k + r)))
        plain = shell + sum(cp[j] - cp[i] + max(0, j - i - 1) for i, j in lists)
        return fixed + _tokens(plain, sum(co[j] - co[i] for i, j in lists))

    rows, a = [], 0
    while a < n:
        tries = [(k, radius) for k in range(min(size, n - a), 0, -1)] + [(1, r) for r in range(radius - 1, -1, -1)]
        pick = next(((k, r) for k, r in tries if cost(a, k, r) + reserve <= budget), None)
        k, r = pick or (1, 0)
        rows.append((max(0, a - r), a, a + k - 1, min(n, a + k + r) - 1, cost(a, k, r), None if pick else "over_budget"))
        a += k
    return rows


def translation_batches(cues: DataFrame, size: int = 10, budget: int = 2000, fixed: int = 300, reserve: int = 500, radius: int = 3) -> DataFrame:
    """Disjoint batches with context on both sides: fewer subjects first, then less context, until the budget is met. A cue over it alone makes a row with ``problem``."""

    def f(g: Group) -> list:
        *at, tokens, problem = zip(*_batch_bounds(g, size, budget, fixed, reserve, radius), strict=True)
        return [[g["media_id"][0]] * len(tokens), range(len(tokens)), *(g["cue_idx"][list(x)] for x in at), tokens, problem]

    return per_item(_json_costs(cues), f, _PLAN)


def translation_rows(cues: DataFrame, size: int = 10, budget: int = 2000, fixed: int = 300, reserve: int = 500, radius: int = 3) -> DataFrame:
    """``(media_id, pos, cue_idx, window_no, part, problem)``: a row for each cue of each batch of ``translation_batches``; ``part`` is -1 before, 0 a subject, 1 after.

    ``pos``: the cue's place in its media item from 0, which ``cues`` hold too.
    """

    def f(g: Group) -> list:
        before, first, last, after, _, problem = zip(*_batch_bounds(g, size, budget, fixed, reserve, radius), strict=True)
        many = np.array(after) - before + 1
        of = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(of)) - np.repeat(many.cumsum() - many, many) + np.array(before)[of]
        part = (place > np.array(last)[of]).astype(int) - (place < np.array(first)[of])
        return [[g["media_id"][0]] * len(of), place, g["cue_idx"][place], of, part, np.array(problem, object)[of]]

    return per_key(spread(_json_costs(cues, "pos"), "media_id").sortWithinPartitions("media_id", "pos"), ["media_id"], f, "media_id long, pos int, cue_idx int, window_no int, part int, problem string")


def pack_summaries(summaries: DataFrame, room: int = 2000) -> DataFrame:
    """``(media_id, pos, pack)``: summaries in order, packed while their tokens fit ``room``; pairs where no two would be packed, so that packing again comes to an end.

    A summary over ``room`` makes a pack of its own.
    """

    def f(g: Group) -> list:
        pack, used, out = 0, 0, []
        for t in g["tokens"].tolist():
            if used and used + t > room:
                pack, used = pack + 1, 0
            used += t
            out.append(pack)
        alone = len(out) == pack + 1
        return [g["media_id"], g["cue_idx"], np.arange(len(out)) // 2 if alone else out]

    s = summaries.select("media_id", F.col("pos").cast("int").alias("cue_idx"), F.col("pos").cast("long").alias("start_ms"), estimate_tokens("text").alias("tokens"))
    return per_item(s, f, "media_id long, pos int, pack int")


def silence_spans(media: DataFrame, silences: DataFrame, length_ms: int = 600_000, overlap_ms: int = 10_000, before_ms: int = 60_000, after_ms: int = 15_000, min_silence_ms: int = 300) -> DataFrame:
    """Chunks that end in a silence near their limit; the next starts ``overlap_ms`` before. ``media``: ``media_id, total_ms``; ``silences``: ranges."""

    def f(key: object, m: Group, s: Group) -> list:
        rows = []
        # Silences by start, and how far those up to each reach: a search looks only at those that may meet it.
        lo, hi = s["start_ms"], s["end_ms"]
        reach = np.maximum.accumulate(hi)
        for total in m["total_ms"].tolist():
            a = 0
            least = max(1000, min(length_ms // 2, 60_000))
            while a < total:
                limit = min(a + length_ms, total)
                if limit >= total:
                    rows.append((key, len(rows), a, total))
                    break
                target = max(a, limit - after_ms)
                x, y = max(a + least, target - before_ms), min(limit, target + after_ms)
                near = slice(int(np.searchsorted(reach, x)), int(np.searchsorted(lo, y, side="right")))
                met = [(max(l, x), min(h, y)) for l, h in zip(lo[near].tolist(), hi[near].tolist(), strict=True)]
                cut = min(((abs((l + h) // 2 - target), l - h, (l + h) // 2) for l, h in met if h - l >= min_silence_ms), default=(0, 0, limit))[2]
                cut = cut if cut > a else limit
                rows.append((key, len(rows), a, cut))
                a = cut - overlap_ms if cut - overlap_ms > a else cut
        return list(zip(*rows, strict=True)) or [()] * 4

    m = media.select("media_id", F.col("total_ms").cast("long").alias("total_ms"), F.lit(0).alias("none"))
    return per_two(m.where("total_ms IS NOT NULL"), silences.select("media_id", "start_ms", "end_ms"), f, "media_id long, chunk_idx int, start_ms long, end_ms long")


#: Opening, closing and straight quotes of each kind, and what opening and closing ones become.
_QUOTES = (("“「", "”」", '"', "「」"), ("‘『", "’』", "'", "『』"))
#: A straight single quote that is no apostrophe within an ASCII word.
_SINGLE = r"(?<![A-Za-z])'|'(?![A-Za-z])"


def _marks(text: Column, opening: str, closing: str, straight: str) -> Column:
    """The quotes of one kind in a text, in order, apostrophes left out; single straight ones as the double one, so that patterns are alike."""
    plain = text if straight == '"' else F.regexp_replace(F.regexp_replace(text, '"', ""), _SINGLE, '"')
    return F.regexp_replace(plain, f'[^{opening}{closing}"]', "")


def _open_before(marks: Column, opening: str) -> tuple[Column, Column, Column, Column]:
    """Columns to add in turn (``given__``, ``total__``, ``reset__``) and the state that they give: whether a straight quote would open at a cue's start.

    A cue with a directional quote leaves a state whatever came before; others turn it over once for each straight quote. So
    the state is the last one set, turned over by the parity of the straight quotes since: a running sum.
    """
    last, since = F.regexp_extract(marks, r'([^"]?)("*)$', 1), F.length(F.regexp_extract(marks, r'([^"]?)("*)$', 2))
    earlier = in_order().rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(since).over(earlier), F.lit(0))
    through = F.sum(since).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    # What was set last, and the count of straight quotes before those that follow it in its own cue.
    given = F.when(last != "", F.struct((~F.lit(opening).contains(last)).alias("opens"), (through - since).alias("upto")))
    reset = F.last("given__", ignorenulls=True).over(earlier)
    opens = F.coalesce(F.col("reset__.opens"), F.lit(True))
    return given, total, reset, opens == ((F.col("total__") - F.coalesce(F.col("reset__.upto"), F.lit(0))) % 2 == 0)


def _turned(text: Column, opens: Column, opening: str, closing: str, straight: str, forms: str) -> Column:
    """A text with its quotes of one kind as ``forms``, from the state at its start.

    Between directional quotes straight ones open and close in turn. So the text is cut before each directional quote, and in
    a piece pairs are replaced, after a first one that closes where the piece opens with an opening quote.
    """
    up, down = forms
    t = F.translate(text, opening + closing, up * len(opening) + down * len(closing))
    # All directional single quotes are corner brackets now, so a curly one is free to stand for the straight ones.
    mark = '"' if straight == '"' else "‘"
    t = t if straight == '"' else F.regexp_replace(t, _SINGLE, mark)
    pieces = F.regexp_extract_all(F.concat(F.when(opens, down).otherwise(up), t), F.lit(f"[{up}{down}][^{up}{down}]*"), F.lit(0))

    def in_turn(piece: Column) -> Column:
        first = F.when(piece.startswith(up), F.regexp_replace(piece, f"^([^{mark}]*){mark}", f"$1{down}")).otherwise(piece)
        pairs = F.regexp_replace(first, f"{mark}([^{mark}]*){mark}", f"{up}$1{down}")
        return F.replace(pairs, F.lit(mark), F.lit(up))

    whole = F.substring(F.array_join(F.transform(pieces, in_turn), ""), 2, 2**31 - 1)
    return F.when(text.rlike(f"[{opening}{closing}{straight}]"), whole).otherwise(text)


def normalize_quotes(cues: DataFrame) -> DataFrame:
    """Quotes of both sides as corner brackets; straight ones open and close in turn, across cues. Apostrophes within ASCII words stay; null counts as empty.

    Each side and kind of quote has its own state, which windows carry through a media item in the order of its cues.
    """
    c = cues.select("media_id", "cue_idx", "start_ms", "end_ms", *[F.coalesce(s, F.lit("")).alias(s) for s in ("text", "translated_text")])
    kept = c.columns
    for side in ("text", "translated_text"):
        for k, (opening, closing, straight, forms) in enumerate(_QUOTES):
            c = c.withColumn(f"marks{k}__", _marks(F.col(side), opening, closing, straight))
        for k, (opening, closing, straight, forms) in enumerate(_QUOTES):
            given, total, reset, opens = _open_before(F.col(f"marks{k}__"), opening)
            c = c.withColumn("given__", given).withColumn("total__", total).withColumn("reset__", reset).withColumn(f"opens{k}__", opens)
        for k, quote in enumerate(_QUOTES):
            c = c.withColumn(side, _turned(F.col(side), F.col(f"opens{k}__"), *quote))
    return c.select(*kept)


class _Timing:
    """Times of one media item under change, and its metrics."""

    def __init__(self, g: Group, policy: SpeedPolicy):
        of = lambda name, kind: np.array(g[name], kind)  # noqa: E731  a copy: times change
        self.p, self.n = policy, len(g["cue_idx"])
        self.start, self.end = of("start_ms", np.int64), of("end_ms", np.int64)
        self.hard, self.comfort = of("hard_s", float), of("comfort_s", float)
        self.rhythm, self.fixed = of("rhythm_id", np.int64), of("protected", bool)
        self.ids, self.target = of("cue_idx", np.int64), of("target_load", float)
        budget = of("boundary_budget_ms", float)
        self.budget = np.where(np.isnan(budget), policy.budget.low, budget).astype(np.int64)
        self.said = of("speech_start_ms", float), of("speech_end_ms", float)
        self.least = round(policy.display.possible * 1000)

    @staticmethod
    def _rank(values: np.ndarray, weights: np.ndarray, ids: np.ndarray, q: float) -> float:
        o = np.lexsort((ids, values))
        upto = weights[o].cumsum()
        return float(values[o][min(np.searchsorted(upto, q * upto[-1]), len(o) - 1)])

    def metrics(self) -> tuple:
        """``(invalid, deficit, unresolved, emergencies, spread, jump)``."""
        dur = (self.end - self.start) / 1000
        ok = dur > 0
        load = np.where(ok, self.comfort / np.where(ok, dur, 1), 0.0)
        need = self.hard[ok].sum()
        deficit = np.maximum(0, self.hard - dur)[ok].sum() / need if need else 0.0
        pos = load > 0
        spread = self._rank(load[pos], dur[pos], self.ids[pos], 0.9) / self._rank(load[pos], dur[pos], self.ids[pos], 0.1) if pos.sum() >= 3 else None
        low, high = np.minimum(load[1:], load[:-1]), np.maximum(load[1:], load[:-1])
        felt = (self.rhythm[1:] == self.rhythm[:-1]) & ok[1:] & ok[:-1] & (low > 0) & (high >= self.p.jump.felt)
        ratio = high[felt] / low[felt]
        jump = self._rank(ratio, np.ones(len(ratio)), self.ids[1:][felt], 0.9) if len(ratio) >= 2 else None
        return int((~ok).sum()), deficit, int((self.hard[ok] / dur[ok] > 1).sum()), int((ratio > self.p.jump.never).sum()), spread, jump

    @staticmethod
    def not_worse(a: tuple, b: tuple) -> bool:
        room = lambda x, y: y is None if x is None else y is None or y <= x * 1.01 + 1e-9
        return b[0] <= a[0] and b[1] <= a[1] + 1e-9 and b[2] <= a[2] and b[3] <= a[3] and room(a[4], b[4]) and room(a[5], b[5])

    @classmethod
    def better(cls, a: tuple, b: tuple) -> bool:
        less = lambda x, y: x is not None and y is not None and y < x * 0.99 - 1e-9
        return cls.not_worse(a, b) and (b[1] < a[1] - 1e-9 or b[3] < a[3] or less(a[4], b[4]) or less(a[5], b[5]))

    def wanted(self, i: int) -> int:
        dur = int(self.end[i] - self.start[i])
        return max(0, round(max(self.hard[i] * 1000 - dur, self.comfort[i] * 1000 / self.target[i] - dur)))

    def shared_shift(self, i: int, k: int, side: int, need: int) -> int:
        """How far cue i may push the boundary it shares with cue k."""
        mine, other = self.said[0 if side < 0 else 1][i], self.said[1 if side < 0 else 0][k]
        edge = self.start[i] if side < 0 else self.end[i]
        free = int(self.end[k] - self.start[k]) - self.least
        if not np.isnan(other):
            free = min(free, int(abs(edge - other)) if (edge - other) * side < 0 else 0)
        budget = int(min(self.budget[i], self.budget[k]))
        hard = max(0, round(self.hard[i] * 1000 - int(self.end[i] - self.start[i])))
        borrow = need if need <= budget else hard if 0 < hard <= budget else 0
        anchored = 0 if np.isnan(mine) else max(0, int((mine - edge) * side))
        asked = max(borrow, anchored)
        if not np.isnan(other) or not np.isnan(mine):
            return min(asked, max(0, free), budget)
        return asked if asked <= free else 0

    def optimize(self) -> list[tuple]:
        """Free gaps first, then shared boundaries, cue by cue; each move stays if the metrics gain. Over 1000 cues all moves stand or fall together."""
        together, log = self.n > 1000, []
        before = now = self.metrics()
        first = self.start.copy(), self.end.copy()
        for i in range(self.n):
            if self.fixed[i] or self.end[i] <= self.start[i] or self.wanted(i) <= 0:
                continue
            for shared, side in ((False, -1), (False, 1), (True, -1), (True, 1)):
                k, need = i + side, self.wanted(i)
                if need <= 0 or not 0 <= k < self.n or self.fixed[k] or self.rhythm[k] != self.rhythm[i]:
                    continue
                gap = int(self.start[i] - self.end[k] if side < 0 else self.start[k] - self.end[i])
                shift = (self.shared_shift(i, k, side, need) if gap == 0 else 0) if shared else min(need, max(0, gap))
                if shift <= 0:
                    continue
                mine, other = (self.start, self.end) if side < 0 else (self.end, self.start)
                old, theirs = int(mine[i]), int(other[k])
                mine[i] = old + side * shift
                if shared:
                    other[k] = mine[i]
                if not together:
                    after = self.metrics()
                    if not self.better(now, after):
                        mine[i], other[k] = old, theirs
                        continue
                    now = after
                name = ("start", "end") if side < 0 else ("end", "start")
                if shared:
                    log.append((self.ids[k], name[1], theirs, int(mine[i]), "shared_boundary"))
                log.append((self.ids[i], name[0], old, int(mine[i]), "shared_boundary" if shared else "safe_gap"))
        if together and not self.better(before, self.metrics()):
            self.start, self.end = first
            return []
        return log

    def balance(self) -> list[tuple]:
        """Move boundaries between unequal neighbours towards equal loads, within budgets and speech."""
        together, log = self.n > 1000, []
        before = self.metrics()
        first = self.start.copy(), self.end.copy()
        for i in range(self.n - 1):
            k = i + 1
            if self.fixed[i] or self.fixed[k] or self.rhythm[i] != self.rhythm[k] or self.end[i] != self.start[k]:
                continue
            da, db = int(self.end[i] - self.start[i]), int(self.end[k] - self.start[k])
            if da <= 0 or db <= 0 or not self.comfort[i] or not self.comfort[k]:
                continue
            loads = lambda x, y: (max(self.comfort[i] / x, self.comfort[k] / y), min(self.comfort[i] / x, self.comfort[k] / y))  # noqa: E731, B023
            high, low = loads(da, db)
            if high / low <= self.p.jump.wanted:
                continue
            move = round((da + db) * self.comfort[i] / (self.comfort[i] + self.comfort[k])) - da
            budget = int(min(self.budget[i], self.budget[k]))
            said_a, said_b = self.said[1][i], self.said[0][k]
            if move == 0 or (abs(move) > budget and np.isnan(said_a) and np.isnan(said_b)):
                continue
            old = int(self.end[i])
            new = old + max(-budget, min(budget, move))
            new = min(int(self.end[k]) - self.least, max(int(self.start[i]) + self.least, new))
            new = new if np.isnan(said_a) else max(int(said_a), new)
            new = new if np.isnan(said_b) else min(int(said_b), new)
            if new == old:
                continue
            now = before if together else self.metrics()
            self.end[i] = self.start[k] = new
            if not together:
                after = self.metrics()
                x, y = int(self.end[i] - self.start[i]), int(self.end[k] - self.start[k])
                evener = x > 0 and y > 0 and loads(x, y)[0] / loads(x, y)[1] < high / low * 0.99
                if not self.not_worse(now, after) or not (self.better(now, after) or evener):
                    self.end[i] = self.start[k] = old
                    continue
            log += [(self.ids[i], "end", old, new, "bidirectional_balance"), (self.ids[k], "start", old, new, "bidirectional_balance")]
        if together and log and not self.not_worse(before, self.metrics()):
            self.start, self.end = first
            return []
        return log


def _targets(g: dict[str, np.ndarray], policy: SpeedPolicy) -> np.ndarray:
    """``metrics.local_targets`` of one media item's ordered cues: the median load of near neighbours in the rhythm, else of the rhythm, else of the media item, else 1."""
    n, ids, rhythm = len(g["cue_idx"]), g["cue_idx"], g["rhythm_id"]
    weight = g["end_ms"] - g["start_ms"]
    seconds = np.where(weight > 0, weight, 1) / 1000
    load = g["comfort_s"] / seconds
    counts = ~g["shielded"] & (weight > 0) & (load > 0) & (g["hard_s"] / seconds <= 1)

    def medians(loads: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each row of three or more counted loads the weighted one in the middle, else NaN."""
        order = np.argsort(loads, axis=1, kind="stable")
        upto = np.take_along_axis(weights, order, axis=1).cumsum(axis=1)
        at = (upto >= 0.5 * upto[:, -1:]).argmax(axis=1)
        middle = np.take_along_axis(loads, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
        return np.where((weights > 0).sum(axis=1) >= 3, middle, np.nan)

    whole = np.where(counts, load, np.inf), np.where(counts, weight, 0)
    k = policy.rhythm.neighbours
    around = np.arange(n)[:, None] + np.arange(-k, k + 1)
    inside = (around >= 0) & (around < n)
    at = np.clip(around, 0, n - 1)
    near = inside & counts[at] & (rhythm[at] == rhythm[:, None]) & (ids[at] != ids[:, None])
    out = medians(np.where(near, load[at], np.inf), np.where(near, weight[at], 0))
    if np.isnan(out).any():
        kinds, of = np.unique(rhythm, return_inverse=True)
        first = np.searchsorted(rhythm, kinds)  # rhythms are numbered in order
        each = [medians(*(v[None, x:y] for v in whole))[0] for x, y in zip(first, [*first[1:], n], strict=True)]
        out = np.where(np.isnan(out), np.array(each)[of], out)
        out = np.where(np.isnan(out), medians(*(v[None, :] for v in whole))[0], out)
    return np.maximum(policy.jump.felt, np.where(np.isnan(out), 1.0, out))


def optimize_timing(cues: DataFrame, policy: SpeedPolicy = SpeedPolicy(), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Cues with better times and the change log ``(media_id, cue_idx, boundary, before_ms, after_ms, reason)``; texts stay.

    Texts are measured once by expressions; one pass over each media item finds its targets and moves boundaries. Optional
    columns ``protected``, ``boundary_budget_ms``, ``speech_start_ms`` and ``speech_end_ms`` limit it.
    """
    c = cues
    for name, kind in (("boundary_budget_ms", "double"), ("speech_start_ms", "double"), ("speech_end_ms", "double")):
        c = c.withColumn(name, F.col(name).cast(kind) if name in cues.columns else F.lit(None).cast(kind))
    # Of texts only their measures, and a mark for those with music, are shuffled.
    c = c.withColumn("load__", reading_load(text, F.lit(None).cast("long"), policy)).withColumn("music__", F.when(F.col(text).rlike(MUSIC), "♪"))
    c = with_protection(with_rhythm(spread(c, "media_id"), policy.rhythm.pause_ms), policy, "music__", units=F.col("load__.units"))
    c = c.withColumn("shielded", F.col("protected_by").isNotNull())
    c = c.withColumn("protected", F.col("shielded") | F.coalesce(F.col("protected"), F.lit(False)) if "protected" in cues.columns else F.col("shielded"))
    c = c.select("media_id", "cue_idx", "start_ms", "end_ms", F.col("load__.hard_s").alias("hard_s"), F.col("load__.comfort_s").alias("comfort_s"), "rhythm_id", "protected", "shielded", "boundary_budget_ms", "speech_start_ms", "speech_end_ms")

    def f(g: dict[str, np.ndarray]) -> list[np.ndarray]:
        t = _Timing(g | {"target_load": _targets(g, policy)}, policy)
        log = t.optimize() + (t.balance() if policy.balance else [])
        idx, boundary, before, after, reason = zip(*log, strict=True) if log else ((),) * 5
        n, texts = len(t.ids), lambda x: np.concatenate([np.full(t.n, None, object), np.array(x, object)])
        return [np.full(n + len(log), g["media_id"][0]), np.concatenate([t.ids, np.array(idx, np.int64)]).astype(np.int32), texts(boundary), np.concatenate([t.start, np.array(before, np.int64)]), np.concatenate([t.end, np.array(after, np.int64)]), texts(reason)]

    # Both results come from one run.
    tagged = keep(per_segment(c.sortWithinPartitions("media_id", "start_ms", "cue_idx"), f, "media_id long, cue_idx int, boundary string, before_ms long, after_ms long, reason string"), "timing")
    times = tagged.where(F.col("boundary").isNull()).select("media_id", "cue_idx", F.col("before_ms").alias("s__"), F.col("after_ms").alias("e__"))
    out = cues.join(times, ["media_id", "cue_idx"]).withColumn("start_ms", F.col("s__")).withColumn("end_ms", F.col("e__")).drop("s__", "e__")
    return out, tagged.where(F.col("boundary").isNotNull())


def merge_ranges_of_cues(cues: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cues of each range of ``ranges(media_id, first_idx, last_idx)`` as one: outer times, texts joined in order. Others stay."""
    r = ranges.select(F.col("media_id").alias("m"), F.col("first_idx").alias("a"), F.col("last_idx").alias("b"))
    j = cues.join(r, (F.col("media_id") == F.col("m")) & F.col("cue_idx").between(F.col("a"), F.col("b")), "left").withColumn("into", F.coalesce("a", "cue_idx"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", F.col(c).alias("t")))), lambda x: x["t"]), " ")
    return j.groupBy("media_id", F.col("into").alias("cue_idx")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.trim(join("text")).alias("text"), F.trim(join("translated_text")).alias("translated_text"))
