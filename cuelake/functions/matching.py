"""Likeness of two texts by common stretches: the longest first, then left and right of it, until nothing is common. Pairs of lines by what stands once in both."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np

#: In texts from this length on, letters that are over a hundredth of the second text begin no stretch; they only lengthen it. Fixed values.
LONG_TEXT, FREQUENT = 200, 100
#: Up to so many equal letters are walked through one by one; more as arrays.
FEW = 400


class Spots:
    """Where each letter of a text stands."""

    def __init__(self, text: str):
        self.text = text
        self.at: dict[str, list[int]] = {}
        for i, c in enumerate(text):
            self.at.setdefault(c, []).append(i)


#: Up to so many pairs of letters are compared at once, a byte each.
AT_ONCE = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _seeds(a: Spots, b: str, frequent: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal letters of ``a`` and ``b`` that may begin a stretch, by place in ``a``, then in ``b``."""
    most = len(b) // FREQUENT + 1 if frequent and len(b) >= LONG_TEXT else len(b)
    if len(a.text) * len(b) <= AT_ONCE:
        x, y = _codes(a.text), _codes(b)
        met = x[:, None] == y
        if most < len(b):
            _, of, n = np.unique(y, return_inverse=True, return_counts=True)
            met &= (n <= most)[of]
        return np.nonzero(met)
    pairs: list[tuple[int, int]] = []
    for c, mine in a.at.items():
        if 0 < b.count(c) <= most:
            theirs, j = [], b.find(c)
            while j >= 0:
                theirs.append(j)
                j = b.find(c, j + 1)
            pairs += [(i, j) for i in mine for j in theirs]
    pairs.sort()
    return np.array([i for i, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int64)


def _ending(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How long a row of seeds, each one letter further on both sides, ends at each seed."""
    order = np.lexsort((i, j - i))
    x, d = i[order], (j - i)[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1] + 1) | (d[1:] != d[:-1])])
    out = np.empty(len(i), np.int64)
    out[order] = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) + 1
    return out


def _longest(x: str, y: str) -> tuple[int, int, int]:
    """``(place in x, place in y, length)`` of the longest common stretch, the first in ``x``, then in ``y``: lengths are tried by halves."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        n = (lo + hi + 1) // 2
        there = {y[j : j + n] for j in range(len(y) - n + 1)}
        lo, hi = (lo, n - 1) if there.isdisjoint([x[i : i + n] for i in range(len(x) - n + 1)]) else (n, hi)
    if not lo:
        return 0, 0, 0
    there = {y[j : j + lo] for j in range(len(y) - lo + 1)}
    i = next(i for i in range(len(x) - lo + 1) if x[i : i + lo] in there)
    return i, y.find(x[i : i + lo]), lo


def _plain_stretches(a: str, b: str) -> Iterator[tuple[int, int, int]]:
    """``stretches`` of short texts, where any letter may begin one."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        p, q, r, s = todo.pop()
        x, y = a[p:q], b[r:s]
        # A part that the other side holds whole is the longest stretch itself.
        i, j, size = (0, y.find(x), len(x)) if x in y else _longest(x, y)
        if size:
            yield p + i, r + j, size
            todo += [t for t in ((p, p + i, r, r + j), (p + i + size, q, r + j + size, s)) if t[0] < t[1] and t[2] < t[3]]


def stretches(a: Spots, b: str, frequent: bool = True) -> Iterator[tuple[int, int, int]]:
    """Common stretches ``(place in a, place in b, length)`` of both texts, in no order.

    Of stretches of equal length the one that begins first in ``a`` is taken, then the one first in ``b``. ``frequent``: long
    texts begin stretches at rarer letters only. Seeds are looked up once; each part of the texts works on those within it.
    """
    text = a.text
    if len(text) < LONG_TEXT and len(b) < LONG_TEXT:
        yield from _plain_stretches(text, b)
        return
    i, j = _seeds(a, b, frequent)
    ends = _ending(i, j) if len(i) else np.zeros(0, np.int64)
    todo: list[tuple] = [(0, len(text), 0, len(b), list(zip(i.tolist(), j.tolist(), ends.tolist(), strict=True)) if len(i) <= FEW else (i, j, ends))]
    while todo:
        alo, ahi, blo, bhi, seeds = todo.pop()
        x, y, size = alo, blo, 0
        if isinstance(seeds, tuple):
            i, j, ends = seeds
            inside = np.minimum(np.minimum(ends, i - alo + 1), j - blo + 1)
            if len(inside):
                k = int(inside.argmax())
                size = int(inside[k])
                x, y = int(i[k]) - size + 1, int(j[k]) - size + 1
        else:
            for i, j, n in seeds:
                n = min(n, i - alo + 1, j - blo + 1)
                if n > size:
                    x, y, size = i - n + 1, j - n + 1, n
        while x > alo and y > blo and text[x - 1] == b[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size < ahi and y + size < bhi and text[x + size] == b[y + size]:
            size += 1
        if not size:
            continue
        yield x, y, size
        for p, q, r, s in ((alo, x, blo, y), (x + size, ahi, y + size, bhi)):
            if p < q and r < s:
                if isinstance(seeds, tuple):
                    keep = (i >= p) & (i < q) & (j >= r) & (j < s)
                    part = (i[keep], j[keep], ends[keep])
                    todo.append((p, q, r, s, part if len(part[0]) > FEW else list(zip(*(v.tolist() for v in part), strict=True))))
                else:
                    todo.append((p, q, r, s, [e for e in seeds if p <= e[0] < q and r <= e[1] < s]))


def matching_letters(a: Spots, b: str, frequent: bool = True) -> int:
    """Letters in common stretches of both texts."""
    return sum(size for *_, size in stretches(a, b, frequent))


def in_order(x: str, y: str) -> int:
    """Letters of ``x`` that stand in ``y`` in the same order, at most: no stretches hold more. One bit of a number is a letter of ``x``."""
    masks: dict[str, int] = {}
    for j, letter in enumerate(x):
        masks[letter] = masks.get(letter, 0) | 1 << j
    whole = left = (1 << len(x)) - 1
    for c in y:
        m = masks.get(c)
        if m:
            met = left & m
            left = ((left + met) | (left - met)) & whole
    return len(x) - left.bit_count()


def shares(x: str, y: str, least: float) -> bool:
    """Whether common stretches hold ``least`` of the letters of ``x`` or more, ``x`` not empty.

    All stretches together hold no more than the letters in the same order, and so in each part that is left. The search ends
    when enough is found, or when the parts can't hold it.
    """
    parts = {(0, len(x), 0, len(y)): in_order(x, y)}
    held, room = 0, sum(parts.values())
    if room / len(x) < least:
        return False
    for i, j, size in stretches(Spots(x), y, frequent=False):
        held += size
        if held / len(x) >= least:
            return True
        p, q, r, s = part = next(t for t in parts if t[0] <= i and i + size <= t[1] and t[2] <= j and j + size <= t[3])
        new = {t: in_order(x[t[0] : t[1]], y[t[2] : t[3]]) for t in ((p, i, r, j), (i + size, q, j + size, s)) if t[0] < t[1] and t[2] < t[3]}
        room += size + sum(new.values()) - parts.pop(part)
        parts |= new
        if room / len(x) < least:
            return False
    return False


def _rising(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``places``, ordered by the first number, in which the second rises too."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(places):
        pile = bisect_left(ends, j)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[pile], at[pile] = j, k
    k, out = at[-1] if at else -1, []
    while k >= 0:
        out.append(places[k])
        k = before[k]
    return out[::-1]


def same_lines(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of equal lines of ``x`` and ``y``, rising in both.

    Lines that stand once in each hold the lists together: of them the longest rising row, and between two of them the same
    again. Where no line stands once in both, the longest common stretches are taken.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(x[a:b]), Counter(y[c:d])
        there = {t: j for j, t in enumerate(y[c:d], c) if theirs[t] == 1}
        anchors = _rising([(i, there[t]) for i, t in enumerate(x[a:b], a) if mine[t] == 1 and t in there])
        if anchors:
            out += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
        elif mine.keys() & theirs.keys():
            # One letter for each line.
            letter = {t: chr(0x10000 + k) for k, t in enumerate(dict.fromkeys([*x[a:b], *y[c:d]]))}
            left, right = ("".join(map(letter.__getitem__, part)) for part in (x[a:b], y[c:d]))
            out += [(a + i + k, c + j + k) for i, j, size in stretches(Spots(left), right, frequent=False) for k in range(size)]
    return sorted(out)


def paired_lines(x: list[str], y: list[str]) -> list[str | None]:
    """For each line of ``x`` its equal in ``y``, or what stands at its place between equal lines; lines without either take the pair of the line before."""
    out: list[str | None] = [None] * len(x)
    i = j = 0
    for k, m in [*same_lines(x, y), (len(x), len(y))]:
        for n in range(min(k - i, m - j)):
            out[i + n] = y[j + n]
        if k < len(x):
            out[k] = y[m]
        i, j = k + 1, m + 1
    for n in range(1, len(out)):
        out[n] = out[n - 1] if out[n] is None else out[n]
    return out


def ratio(a: Spots | str, b: str, frequent: bool = True) -> float:
    """Twice the letters in common stretches over the letters of both; 1 for two empty texts."""
    a = a if isinstance(a, Spots) else Spots(a)
    n = len(a.text) + len(b)
    if a.text == b:
        # Equal texts are one stretch.
        return 1.0
    return 2.0 * matching_letters(a, b, frequent) / n


def bound(a: str, b: str) -> float:
    """A likeness that ``ratio`` can't be over: letters of both, whatever their order."""
    n = len(a) + len(b)
    return 2.0 * sum(min(a.count(c), b.count(c)) for c in set(a)) / n if n else 1.0
