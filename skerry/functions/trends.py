"""Discordant pairs and order statistics of pairwise slopes, by counting and not by listing pairs.

A pair of points has a slope under s exactly if it is discordant in z = y - s x, so the number of slopes under any s is a
number of inversions, found by merging in n log n.  The k-th least slope is searched between two values by such counts;
slopes of points that lie next to each other in z are tried first, so that the search ends at a slope of the data.
"""

from __future__ import annotations

import math

import numpy as np

#: Points up to which all slopes are listed in one array.
LISTED = 512
#: Pairs that are drawn for a first guess.
GUESSED = 20_000
MAX_STEPS = 400


def discordant(x: np.ndarray, z: np.ndarray) -> int:
    """Pairs with x_i < x_j and z_i > z_j."""
    z = np.unique(z, return_inverse=True)[1][np.lexsort((z, x))].astype(np.int64)
    n, found, width = len(z), 0, 1
    if n < 2:
        return 0
    size = 1 << (n - 1).bit_length()
    # values that fill up the last run are greater than all others
    runs, top = np.full(size, n, np.int64), n + 1
    runs[:n] = z
    while width < size:
        halves = runs.reshape(-1, 2, width)
        lift = np.arange(len(halves), dtype=np.int64)[:, None] * top
        left, right = (halves[:, 0] + lift).ravel(), (halves[:, 1] + lift).ravel()
        # how many of its own left half are at most each right one
        at_most = np.searchsorted(left, right, side="right") - np.repeat(np.arange(len(halves)), width) * width
        found += int((width - at_most).sum())
        runs = np.sort(runs.reshape(-1, 2 * width), axis=1).ravel()
        width *= 2
    return found


def tied_pairs(*columns: np.ndarray) -> int:
    """Pairs that are equal in all columns."""
    c = np.unique(np.column_stack(columns), axis=0, return_counts=True)[1].astype(object) if len(columns) > 1 else np.unique(columns[0], return_counts=True)[1].astype(object)
    return int((c * (c - 1) // 2).sum()) if len(c) else 0


def neighbours(x: np.ndarray, y: np.ndarray, s: float) -> np.ndarray:
    """Slopes of points that follow each other in the order of y - s x."""
    order = np.lexsort((x, y - s * x))
    dx, dy = np.diff(x[order]), np.diff(y[order])
    return np.sort((dy / np.where(dx == 0, np.nan, dx))[dx != 0])


def drawn(x: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Slopes of pairs drawn at random."""
    r = np.random.default_rng(seed)
    i, j = r.integers(0, len(x), GUESSED), r.integers(0, len(x), GUESSED)
    keep = x[i] != x[j]
    return np.sort((y[j] - y[i])[keep] / (x[j] - x[i])[keep])


def grain(x: np.ndarray, y: np.ndarray) -> float:
    """Slopes nearer than this are taken as one: what rounding can do to y - s x."""
    spread = float(np.ptp(x)) or 1.0
    return 1e-12 * (float(np.ptp(y)) / spread + 1e-300)


class Search:
    """The k-th least of ``pairs`` slopes: it is at least ``low`` (``under_low`` slopes are less, fewer than k) and under ``high``."""

    def __init__(self, k: int, pairs: int, grain: float, low: float = -math.inf, high: float = math.inf, under_low: int = 0, under_high: int | None = None) -> None:
        self.k, self.pairs, self.grain = k, pairs, grain
        self.low, self.high, self.under_low, self.under_high = low, high, under_low, pairs if under_high is None else under_high

    def narrow(self, counts: dict[float, int]) -> None:
        for s, under in counts.items():
            if under < self.k and s > self.low:
                self.low, self.under_low = s, under
            elif under >= self.k and s < self.high:
                self.high, self.under_high = s, under

    def step(self) -> float:
        return max(self.grain, 4e-16 * max(abs(x) for x in (self.low, self.high, 0.0) if math.isfinite(x)))

    def done(self) -> bool:
        return self.high - self.low <= 4 * self.step()

    def found(self, near: np.ndarray) -> float:
        """The slope, from slopes of the data where one is between the limits."""
        a, b = self.low - self.step(), self.high + self.step()
        inside = near[(near >= a) & (near <= b)]
        return float(inside[len(inside) // 2]) if len(inside) else (self.low + self.high) / 2

    def probes(self, near: np.ndarray) -> list[float]:
        """Values to count next: around a slope of the data where the k-th should be, and one to either side."""
        share = (self.k - self.under_low) / max(1, self.under_high - self.under_low)
        inside = near[(near > self.low) & (near < self.high)]
        if len(inside):
            at = min(len(inside) - 1, int(share * len(inside)))
            reach = max(1, int(0.03 * len(inside)))
            tried = [inside[max(0, at - reach)] - self.step(), inside[at] - self.step(), inside[at] + self.step(), inside[min(len(inside) - 1, at + reach)] + self.step()]
            if math.isfinite(self.low) and math.isfinite(self.high):
                tried.append((self.low + self.high) / 2)
        elif math.isfinite(self.low) and math.isfinite(self.high):
            aim, width = self.low + share * (self.high - self.low), (self.high - self.low) / 64
            tried = [aim - width, aim, aim + width, (self.low + self.high) / 2]
        else:
            ends = [e for e in (self.low, self.high) if math.isfinite(e)] or [0.0]
            reach = max(1.0, *map(abs, ends))
            tried = [e + d * reach for e in ends for d in (-1024.0, -2.0, 2.0, 1024.0)]
        kept = sorted({float(s) for s in tried if self.low < s < self.high})
        return kept or [(self.low + self.high) / 2]


def select(x: np.ndarray, y: np.ndarray, ranks: list[int]) -> list[float]:
    """The slopes of the given ranks (from 1) among all pairs with different x, of one series."""
    if len(x) <= LISTED:
        i, j = np.triu_indices(len(x), 1)
        dx = x[j] - x[i]
        slopes = np.sort((y[j] - y[i])[dx != 0] / dx[dx != 0])
        return [float(slopes[k - 1]) for k in ranks]
    pairs, known, found = len(x) * (len(x) - 1) // 2 - tied_pairs(x), {}, []
    near = drawn(x, y)
    for k in ranks:
        search, own = Search(k, pairs, grain(x, y)), near
        search.narrow(known)
        for _ in range(MAX_STEPS):
            if search.done():
                break
            counts = {s: discordant(x, y - s * x) for s in search.probes(own)}
            known |= counts
            search.narrow(counts)
            if math.isfinite(search.low) and math.isfinite(search.high):
                own = neighbours(x, y, (search.low + search.high) / 2) if len(own) and not ((own > search.low) & (own < search.high)).any() else own
                if not len(own[(own > search.low) & (own < search.high)]):
                    own = neighbours(x, y, (search.low + search.high) / 2)
        found.append(search.found(np.concatenate([neighbours(x, y, (search.low + search.high) / 2), near])))
    return found
