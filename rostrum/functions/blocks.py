"""Matching blocks of two token sequences: the longest common run, then those before and after it, as `difflib` defines them.

Runs are compared by name: a window of 2**k tokens has a number that equal windows share, made from the numbers of its halves, so a
window of any length is told by two of them, exactly and without comparing tokens. A range's longest run is found by
bisection over the length, and all runs of that length are taken in one pass from the left; what lies between them is done
with a smaller bound. So a range is gone over once for each length of run in it, not once for each run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Sequence

import numpy as np

#: Ranges of up to so many tokens together are gone over token by token.
SHORT = 48


class _Names:
    """Numbers of the windows of a and b."""

    def __init__(self, a: Sequence[Hashable], b: Sequence[Hashable]) -> None:
        known: dict[Hashable, int] = {}
        first = np.array([known.setdefault(x, len(known)) for x in (*a, *b)], np.int64)
        self.m, self.levels = len(a), [(first[: len(a)], first[len(a) :])]

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.levels) <= k:
            half = 1 << len(self.levels) - 1
            pairs = [x[: max(len(x) - half, 0)] << 32 | x[half:] for x in self.levels[-1]]
            names = np.unique(np.concatenate(pairs), return_inverse=True)[1]
            self.levels.append((names[: len(pairs[0])], names[len(pairs[0]) :]))
        return self.levels[k]

    def windows(self, n: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[np.ndarray, np.ndarray]:
        """One number for each window of n tokens in the two ranges."""
        k = n.bit_length() - 1
        rest = n - (1 << k)
        return tuple(x[lo : hi - n + 1] << 32 | x[lo + rest : hi - n + 1 + rest] for x, lo, hi in zip(self.level(k), (alo, blo), (ahi, bhi), strict=True))

    def meet(self, n: int, *where: int) -> bool:
        a, b = self.windows(n, *where)
        return len(np.intersect1d(a, b)) > 0 if len(a) and len(b) else False


def _longest(names: _Names, most: int, *where: int) -> int:
    n = 1
    while n <= most and names.meet(n, *where):
        n *= 2
    lo, hi = n // 2, min(n - 1, most)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if names.meet(mid, *where):
            lo = mid
        else:
            hi = mid - 1
    return lo


def _short(names: _Names, alo: int, ahi: int, blo: int, bhi: int, out: list[tuple[int, int, int]]) -> None:
    """The blocks of a short range, in the same order of choice, token by token."""
    a, b = (x[lo:hi].tolist() for x, lo, hi in zip(names.levels[0], (alo, blo), (ahi, bhi), strict=True))
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        best, runs = (0, 0, 0), {}
        for i in range(al, ah):
            now = {}
            for j in places.get(a[i], ()):
                if bl <= j < bh:
                    n = now[j] = runs.get(j - 1, 0) + 1
                    if n > best[2]:
                        best = (i - n + 1, j - n + 1, n)
            runs = now
        i, j, n = best
        if n:
            out.append((alo + i, blo + j, n))
            todo += [(al, i, bl, j), (i + n, ah, j + n, bh)]


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the blocks, in order. Of runs of equal length the first in a is taken, of those
    the first in b. Blocks that touch in both are two."""
    names, out = _Names(a, b), []
    todo = [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        most = min(most, ahi - alo, bhi - blo)
        if most <= 0:
            continue
        if ahi - alo + bhi - blo <= SHORT:
            _short(names, alo, ahi, blo, bhi, out)
            continue
        n = _longest(names, most, alo, ahi, blo, bhi)
        if not n:
            continue
        mine, other = names.windows(n, alo, ahi, blo, bhi)
        order = np.argsort(other, kind="stable")
        lo, hi = (np.searchsorted(other[order], mine, side) for side in ("left", "right"))
        order = order.tolist()
        now_a, now_b = alo, blo
        for x in np.flatnonzero(hi > lo).tolist():
            i = alo + x
            if i < now_a:
                continue
            at = bisect_left(order, now_b - blo, lo[x], hi[x])
            if at == hi[x]:
                continue
            j = blo + order[at]
            out.append((i, j, n))
            todo.append((now_a, i, now_b, j, n - 1))
            now_a, now_b = i + n, j + n
        todo.append((now_a, ahi, now_b, bhi, n - 1))
    return sorted(out)


def ratio(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """Twice the tokens in matching blocks as a share of all tokens; 1 for two empty sequences."""
    return 2 * sum(n for *_, n in matching_blocks(a, b)) / (len(a) + len(b)) if len(a) + len(b) else 1.0
