"""What a row's neighbours in a band of sizes have: counts and quantiles, without pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def kth_in_ranges(ranks: np.ndarray, first: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th least (from 0) of ``ranks[first:end]`` for each range at once; ``ranks`` is a permutation of 0..n-1, 0 <= k < end - first.

    A wavelet matrix, of which one level is held at a time: n rows and q ranges take
    log2(n) passes over both, however wide the ranges are.
    """
    row, first, end, k, got = ranks, first.copy(), end.copy(), k.copy(), np.zeros(len(k), np.int64)
    for level in reversed(range(max(1, int(len(ranks) - 1).bit_length()))):
        ones = (row >> level & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        a, b = zeros[first], zeros[end]
        right = k >= b - a
        got |= right.astype(np.int64) << level
        k -= np.where(right, b - a, 0)
        first, end = np.where(right, zeros[-1] + first - a, a), np.where(right, zeros[-1] + end - b, b)
        row = np.concatenate([row[~ones], row[ones]])
    return got


class _Rows:
    """The rows of one industry in order of size, and where each row's band begins and ends among the material ones."""

    def __init__(self, own: np.ndarray, size: np.ndarray, value: np.ndarray, material: np.ndarray, band: float):
        self.own = own[np.argsort(size[own], kind="stable")]
        at, self.is_peer = size[self.own], material[self.own]
        low, high = at / band, at * band
        self.banded = np.searchsorted(at, high, "right") - np.searchsorted(at, low, "left") - 1
        peers, self.values = at[self.is_peer], value[self.own][self.is_peer]
        self.first, self.end = np.searchsorted(peers, low, "left"), np.searchsorted(peers, high, "right")
        self.material = self.end - self.first - self.is_peer

    def quantiles(self, mine: np.ndarray, shares: Sequence[float]) -> Iterator[np.ndarray]:
        """Of the rows ``mine`` (those with material peers), the interpolated quantiles of the peers' values, themselves left out."""
        order = np.argsort(self.values, kind="stable")
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        n, first, end = self.material[mine], self.first[mine], self.end[mine]
        me = np.full(len(mine), len(order))
        me[self.is_peer[mine]] = ranks[(np.cumsum(self.is_peer) - 1)[mine][self.is_peer[mine]]]

        def kth(k: np.ndarray) -> np.ndarray:
            got = kth_in_ranges(ranks, first, end, k)
            later = got >= me  # the row itself stands before: the next one is meant
            got[later] = kth_in_ranges(ranks, first[later], end[later], k[later] + 1)
            return self.values[order[got]]

        for share in shares:
            place = (n - 1) * share
            low = np.floor(place).astype(np.int64)
            high = np.minimum(low + 1, n - 1)
            a, b = kth(low), kth(high)
            yield np.where(place == low, a, (low + 1 - place) * a + (place - low) * b)


def banded_ladder(industry: np.ndarray, size: np.ndarray, value: np.ndarray, material: np.ndarray, *, band: float, least: int, divisors: Sequence[int], shares: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row the first of ``divisors`` (its place, else -1) with ``least`` material others of the same industry (code over the divisor) and within the band of sizes; how many others, and how many material others; quantiles of the latter's values.

    ``value`` of a material row is a number.  Time goes with n log n, memory with n.
    """
    step, banded, count = np.full(len(size), -1), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    found = np.full((len(shares), len(size)), np.nan)
    for k, divisor in enumerate(divisors):
        code = np.fix(industry / divisor)
        order = np.argsort(code, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            if not len(own) or (step[own] >= 0).all():
                continue
            rows = _Rows(own, size, value, material, band)
            served = (step[rows.own] < 0) & (rows.material >= least)
            to = rows.own[served]
            step[to], banded[to], count[to] = k, rows.banded[served], rows.material[served]
            mine = np.flatnonzero(served & (rows.material > 0))
            if len(mine):
                for q, got in zip(found, rows.quantiles(mine, shares)):
                    q[rows.own[mine]] = got
    return step, banded, count, found
