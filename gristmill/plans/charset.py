"""Sets of code points as sorted, disjoint, inclusive ranges."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

Ranges = tuple[tuple[int, int], ...]
TOP = 0x10FFFF
#: Every scalar value.
ALL: Ranges = ((0, 0xD7FF), (0xE000, TOP))
OCTETS: Ranges = ((0, 0xFF),)


def ranges(pairs: Iterable[tuple[int, int]]) -> Ranges:
    """Any ranges, joined and in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def of(text: str) -> Ranges:
    return ranges((ord(c), ord(c)) for c in text)


def union(*sets: Ranges) -> Ranges:
    return ranges(r for s in sets for r in s)


def intersect(a: Ranges, b: Ranges) -> Ranges:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo <= hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def complement(a: Ranges, within: Ranges = ALL) -> Ranges:
    gaps, at = [], 0
    for lo, hi in a:
        if lo > at:
            gaps.append((at, lo - 1))
        at = hi + 1
    if at <= TOP:
        gaps.append((at, TOP))
    return intersect(tuple(gaps), within)


def subtract(a: Ranges, b: Ranges) -> Ranges:
    return intersect(a, complement(b))


def symmetric(a: Ranges, b: Ranges) -> Ranges:
    return union(subtract(a, b), subtract(b, a))


def size(a: Ranges) -> int:
    return sum(hi - lo + 1 for lo, hi in a)


class Test:
    """Fast membership: a bit mask for ASCII, binary search beyond."""

    __slots__ = ("mask", "lows", "highs")

    def __init__(self, a: Ranges):
        self.mask = 0
        for lo, hi in a:
            if lo < 128:
                self.mask |= ((1 << (min(hi, 127) - lo + 1)) - 1) << lo
        self.lows = [lo for lo, _ in a]
        self.highs = [hi for _, hi in a]

    def __call__(self, value: int) -> bool:
        if value < 128:
            return bool(self.mask >> value & 1)
        i = bisect_right(self.lows, value) - 1
        return i >= 0 and value <= self.highs[i]
