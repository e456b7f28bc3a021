"""How many tables a dish has: draws from the exact conditional distribution.

A dish with c customers in a restaurant whose other dishes have T tables, base probability b,
discount d and strength s has t tables with probability proportional to

    S(c, t) * b^t * (s + d T) (s + d (T + 1)) ... (s + d (T + t - 1)),

S(c, t) being the generalised Stirling numbers, S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t):
the weights of all seatings of the c customers at t tables. One draw stands for any number of
moves of single customers, at a cost that does not grow with their order or number of sweeps.

Up to ``EXACT`` customers the numbers come from the recursion. Beyond, with x = t / c^d: for
x <= 1 from the alternating sum of rising factorials (no cancellation there), above from the
saddle point of their generating function ((1 - (1 - z)^d) / d)^t / t!, brought to the value of
the sum at x = 1. The test compares both with the recursion.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT = 512
#: Terms of the alternating sum; log weight below the largest at which a count is left out.
TERMS, NEGLIGIBLE = 40, 20.0
#: Numbers of tables whose alternating sums are computed at a time.
TERM_ROWS = 4096
#: Cells of one matrix of weights; counts of a large dish at which its weight is computed, in each of
#: three looks for the range that holds it and in that range (linear between them).
CELLS, LOOK, POINTS = 250_000, 16, 32
#: Dishes of up to so many customers are weighed without logarithms: no product leaves the range of doubles.
PLAIN = 16
#: Newton steps to the saddle point: from the start the slope changes by a factor of two at most.
NEWTON = 8


def lgamma(x) -> np.ndarray:
    """log Gamma of positive numbers (Stirling's series, after a shift by eight unless all are large)."""
    x = np.asarray(x, float)
    shift = 0.0
    if x.size and x.min() < 64:
        for k in range(8):
            shift = shift + np.log(x + k)
        x = x + 8
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


@lru_cache(maxsize=4)
def recursion(d: float, most: int) -> np.ndarray:
    """log S(c, t) of up to ``most`` customers, [t - 1, c]; a task asks for the same few again and again."""
    table = np.full((most + 1, most), -np.inf)
    table[1, 0] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        table[c + 1, :c] = table[c, :c] + np.log(c - d * t)
        table[c + 1, 1:c + 1] = np.logaddexp(table[c + 1, 1:c + 1], table[c, :c])
    table = np.ascontiguousarray(table.T)
    table.flags.writeable = False
    return table


class Stirling:
    """log S(c, t) for one discount: rows by the recursion up to ``EXACT``, formulas beyond."""

    def __init__(self, d: float, most: int):
        self.d, self.most = d, min(most, EXACT)
        self.table = recursion(d, self.most)      # [t - 1, c]

    def log(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log S for more than ``EXACT`` customers (floats of one shape)."""
        edge = c ** self.d
        few = t <= edge
        out = np.empty(t.shape)
        if few.any():
            out[few] = self._alternating(c[few], t[few])
        if not few.all():
            c, t, edge = c[~few], t[~few], np.maximum(edge[~few], 1.0)
            # the two forms differ by a few percent at the edge, less beyond
            kinds, at = np.unique(c, return_inverse=True)
            gap = self._alternating(kinds, kinds ** self.d) - self._saddle(kinds, kinds ** self.d)
            fade = (edge / t) ** max(1.0, self.d / (1 - self.d))
            out[~few] = np.where(t >= c, 0.0, self._saddle(c, t) + gap[at] * fade)
        return out

    def _alternating(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        # what depends on the count alone is computed once a count: a dish is asked for many numbers of tables
        kinds, at = np.unique(c, return_inverse=True)
        d, whole, j = self.d, lgamma(kinds), np.arange(1, TERMS + 1)[:, None]
        # a term over the one before: (t - j + 1) / j times what depends on the count
        rising = lgamma(kinds - j * d) + lgamma(1 + j * d)
        ratio = np.exp(np.diff(rising, axis=0, prepend=whole[None])) / j
        sign = np.sin(np.pi * np.arange(1, TERMS + 1) * d) * (-1.0) ** np.arange(2, TERMS + 2)
        total = np.empty(t.shape)
        for i in range(0, len(t), TERM_ROWS):
            some = slice(i, i + TERM_ROWS)
            x, by = t[some], ratio[:, at[some]]
            term, add = np.ones(x.shape), np.zeros(x.shape)
            for k in range(min(TERMS, int(x.max()))):
                term *= by[k] * np.maximum(x - k, 0.0)      # none beyond t
                add += term * sign[k]
            total[some] = add
        return np.log(np.maximum(total, 1e-300) / np.pi) + whole[at] - t * np.log(d) - lgamma(t + 1)

    def _saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        # x = log v, v = 1 - z: log(t d (1 - v) v^d) - log(c (1 - v^d) v) falls, is convex, has slopes between
        # d - 1 and (d - 1) / 2, and nears the line that starts the search from the left, where Newton's steps stay
        d = self.d
        slope, ahead = 1 - d, np.log(t * d / c)
        x = np.clip(ahead / slope, -40.0, -1e-12)
        for _ in range(NEWTON):
            rest, rest_d = -np.expm1(x), -np.expm1(d * x)
            value = ahead + np.log(rest / rest_d) - slope * x
            x = np.clip(x + value / (1 / rest - d / rest_d), -40.0, -1e-12)
        v = np.exp(x)
        z, f = 1 - v, (1 - v ** d) / d
        curve = c + t * z * z * (1 - d) * v ** (d - 2) / f - c * c / t
        return (lgamma(c + 1) - lgamma(t + 1) + t * np.log(f) - c * np.log(np.maximum(z, 1e-300))
                - 0.5 * np.log(2 * np.pi * np.maximum(curve, 1e-9)))


def _pick(rng, weight: np.ndarray) -> np.ndarray:
    """One row of each column of log weights, by its weight."""
    w = np.exp(weight - weight.max(axis=0))
    for i in range(1, len(w)):
        w[i] += w[i - 1]
    return (w < rng.random(w.shape[1]) * w[-1]).sum(axis=0)


def _pick_plain(rng, ways: np.ndarray, c: np.ndarray, base: np.ndarray, theta: np.ndarray, d: float) -> np.ndarray:
    """Tables less one of small dishes; ``ways``: S(c, t) / S(c, 1), [t - 1, c]."""
    w, term = np.ones((len(ways), len(c))), 1.0
    for k in range(1, len(ways)):
        term = term * (base * (theta + d * k))
        w[k] = w[k - 1] + term * ways[k, c]
    return (w < rng.random(len(c)) * w[-1]).sum(axis=0)


def draw(rng, numbers: Stirling, c: np.ndarray, base: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Tables of each dish; ``theta`` = s + d * tables of the restaurant's other dishes."""
    d, out = numbers.d, np.ones(len(c), np.int64)
    width = 1 << np.ceil(np.log2(np.maximum(c, 1))).astype(np.int64)      # dishes of up to ``width`` customers together
    for w in np.unique(width[c <= numbers.most]).tolist():
        dishes = np.flatnonzero((width == w) & (c <= numbers.most))
        w = min(w, numbers.most)
        k, step = np.arange(w)[:, None], max(1, CELLS // w)
        ways = np.exp(numbers.table[:w, :w + 1] - numbers.table[0, np.maximum(np.arange(w + 1), 1)]) if w <= PLAIN else None
        for i in range(0, len(dishes), step):
            at = dishes[i:i + step]
            if ways is not None:
                out[at] = 1 + _pick_plain(rng, ways, c[at], base[at], theta[at], d)
                continue
            weight = np.log(base[at] * (theta[at] + d * k))      # a column for each dish
            for j in range(1, w):
                weight[j] += weight[j - 1]
            out[at] = 1 + _pick(rng, weight + numbers.table[:w, c[at]])
    large = np.flatnonzero(c > numbers.most)
    for i in range(0, len(large), 2000):
        at = large[i:i + 2000]
        out[at] = _draw_large(rng, numbers, c[at], base[at], theta[at])
    return out


def _draw_large(rng, numbers: Stirling, c: np.ndarray, base: np.ndarray, theta: np.ndarray) -> np.ndarray:
    d, n = numbers.d, len(c)
    c_, slope, start = c[:, None].astype(float), np.log(base * d)[:, None], (theta / d)[:, None]

    def weight(t: np.ndarray) -> np.ndarray:
        return numbers.log(np.broadcast_to(c_, t.shape), t) + t * slope + lgamma(start + t) - lgamma(start)

    # the range that holds the weight, looked for on finer and finer points
    low, high = np.ones(n), c.astype(float)
    for look in range(4):
        share = np.linspace(0, 1, POINTS if look == 3 else LOOK)
        t = np.exp(np.log(low)[:, None] + share * np.log(high / low)[:, None]) if look == 0 else low[:, None] + share * (high - low)[:, None]
        t = np.clip(np.round(t), 1, c_)
        w = weight(t)
        if look == 3:
            break
        near = w > w.max(axis=1, keepdims=True) - NEGLIGIBLE
        first, last = near.argmax(axis=1), LOOK - 1 - near[:, ::-1].argmax(axis=1)
        low = t[np.arange(n), np.maximum(first - 1, 0)]
        high = t[np.arange(n), np.minimum(last + 1, LOOK - 1)]
    out, chance = np.empty(n, np.int64), rng.random(n)
    for i in range(n):
        every = np.arange(t[i, 0], t[i, -1] + 1, max(1, (t[i, -1] - t[i, 0]) // 50_000))
        size = np.interp(every, t[i], w[i])
        size = np.cumsum(np.exp(size - size.max()))
        out[i] = every[np.searchsorted(size, chance[i] * size[-1])]
    return out
