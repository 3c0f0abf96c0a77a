"""NumPy kernels over one light curve: trigonometric sums by recurrence, power, peaks, running backgrounds.

What a task holds at once is bounded by ``BLOCK`` frequencies times ``CHUNK`` points, whatever the grid and the curve.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np

#: frequencies at once, points at once
BLOCK, CHUNK = 512, 4096
#: values of trials at once
VALUES = 65_536


def turns(x: np.ndarray, count: int) -> np.ndarray:
    """``exp(i k x)`` for k from 0 to ``count - 1`` (rows) by doubling: each half is the half before times one power."""
    out = np.empty((count, len(x)), complex)
    out[0] = 1
    have = 1
    while have < count:
        more = min(have, count - have)
        out[have : have + more] = out[:more] * np.exp(1j * have * x)
        have += more
    return out


class Curve:
    """Points of a source by band: times from its first one, values from a level near their mean, and weights."""

    def __init__(self, t: np.ndarray, y: np.ndarray, w: np.ndarray, band: np.ndarray, bands: int) -> None:
        order = np.argsort(band, kind="stable")
        self.t, self.y, self.w = t[order], y[order], w[order]
        edges = np.searchsorted(band[order], np.arange(bands + 1))
        self.parts = [(b, slice(a, min(a + CHUNK, edges[b + 1]))) for b in range(bands) for a in range(edges[b], edges[b + 1], CHUNK)]
        self.bands = bands
        #: by band: points, weight, and weighted sums of y and its square
        self.totals = np.zeros((bands, 4))
        for b, s in self.parts:
            w, y = self.w[s], self.y[s]
            self.totals[b] += (len(w), w.sum(), (w * y).sum(), (w * y * y).sum())

    def blocks(self, f0: float, df: float, nf: int, values: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per block of the grid: its first k, sums of w and of w y (times e^ix), and of w (times e^2ix): bands x frequencies (x columns of ``values``)."""
        step = 2 * np.pi * df * self.t
        ladder = {id(s): turns(step[s], min(nf, BLOCK)) for _, s in self.parts} if len(self.t) <= CHUNK else {}
        for k in range(0, nf, BLOCK):
            count = min(BLOCK, nf - k)

            def at(s: slice, k: int = k, count: int = count) -> np.ndarray:
                rows = ladder[id(s)] if ladder else turns(step[s], count)
                return rows[:count] * np.exp(2j * np.pi * (f0 + k * df) * self.t[s])

            yield k, *self._summed(at, count, values)

    def at(self, f: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same sums at any few frequencies."""
        return self._summed(lambda s: np.exp(2j * np.pi * f[:, None] * self.t[s]), len(f), values)

    def own_power(self, f: np.ndarray, values: np.ndarray, sums: list[np.ndarray], least: int = 4, even: bool = False) -> np.ndarray:
        """Power at frequencies of each column's own: ``f`` is columns x frequencies (with ``even``, steps of one size), as the result; ``sums`` as of ``power``."""
        count = f.shape[1]
        step = 2j * np.pi * (f[:, -1:] - f[:, :1]) / max(count - 1, 1)
        first, second = np.zeros((self.bands, *f.shape, 2), complex), np.zeros((self.bands, *f.shape), complex)
        for b, s in self.parts:
            w, z, have = self.w[s], np.empty((*f.shape, s.stop - s.start), complex), 1 if even else count
            z[:, :have] = np.exp(2j * np.pi * f[:, :have, None] * self.t[s])
            while have < count:  # as in ``turns``
                more = min(have, count - have)
                z[:, have : have + more] = z[:, :more] * np.exp(have * step * self.t[s])[:, None]
                have += more
            both = np.stack([np.broadcast_to(w, (len(f), len(w))), (w[:, None] * values[s]).T], axis=2)
            first[b] += z @ both
            second[b] += (z * z) @ w
        each = [np.repeat(x, f.shape[1], axis=1)[..., None] for x in sums]
        return power(self.totals, first.reshape(self.bands, -1, 2), second.reshape(self.bands, -1), least, each)[:, 0].reshape(f.shape)

    def _summed(self, turned, count: int, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        columns = 2 if values is None else 1 + values.shape[1]
        first, second = np.zeros((self.bands, count, columns), complex), np.zeros((self.bands, count), complex)
        for b, s in self.parts:
            z, w = turned(s), self.w[s]
            y = self.y[s, None] if values is None else values[s]
            first[b] += z @ np.hstack([w[:, None], w[:, None] * y])
            second[b] += (z * z) @ w
        return first, second


def power(totals: np.ndarray, first: np.ndarray, second: np.ndarray, least: int = 4, sums: np.ndarray | None = None) -> np.ndarray:
    """Generalised Lomb-Scargle power: frequencies (x columns), bands of ``least`` points or more weighted by their scatter.

    ``sums``: by band, the weighted sums of each column's values and squares, where they aren't those of ``totals``.
    """
    wy, wyy = (totals[:, 2, None], totals[:, 3, None]) if sums is None else sums
    over, under = np.zeros(first[0, :, 1:].shape), np.zeros(wy.shape[1:])
    for b in range(len(totals)):
        n, weight = totals[b, :2]
        if n < least or not weight > 0:
            continue
        z, twice = first[b] / weight, second[b] / weight
        c, s = z[:, 0].real, z[:, 0].imag
        cc, ss, cs = (1 + twice.real) / 2 - c * c, (1 - twice.real) / 2 - s * s, twice.imag / 2 - c * s
        mean = wy[b] / weight
        yc, ys = z[:, 1:].real - mean * c[:, None], z[:, 1:].imag - mean * s[:, None]
        scatter = np.maximum(wyy[b] - weight * mean**2, 0)
        d = cc * ss - cs * cs
        with np.errstate(divide="ignore", invalid="ignore"):
            p = (ss[:, None] * yc**2 + cc[:, None] * ys**2 - 2 * cs[:, None] * yc * ys) / d[:, None] * weight  # scatter x power
        over += np.where((np.abs(d) > 1e-12)[:, None] & (scatter > 0), p, 0)
        under += scatter
    with np.errstate(divide="ignore", invalid="ignore"):
        return over / under


def local_maxima(p: np.ndarray) -> np.ndarray:
    """Places of local maxima, a flat top by its middle (rounded down); the ends are none."""
    if len(p) < 3:
        return np.zeros(0, int)
    start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))  # runs of equal values
    v, stop = p[start], np.append(start[1:], len(p)) - 1
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (start[top] + stop[top]) // 2


def prominences(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far each of the maxima ``at`` stands over the higher of its two bases, which reach to the next higher point or the end.

    Between two maxima only the lowest point counts, and a stack of the maxima that are
    not yet overtopped gives each its base, in time linear in the curve.
    """
    if not len(at):
        return np.zeros(0)
    tops = np.unique(np.concatenate([[0], local_maxima(p), [len(p) - 1]]))
    heights, valleys = p[tops], np.append(np.minimum.reduceat(p, tops)[:-1], p[-1])  # lowest from a top to the next

    def bases(height: list[float], valley: list[float]) -> list[float]:
        """The lowest point between each top and the last higher one before it; ``valley``: between a top and the one before."""
        out, stack = [], []
        for v, low in zip(height, valley, strict=True):
            low = min(low, v)
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            out.append(low)
            stack.append((v, low))
        return out

    h = heights.tolist()
    gap = [min(a, b) for a, b in zip(valleys[:-1].tolist(), heights[1:].tolist(), strict=True)]
    left = bases(h, [h[0], *gap])
    right = bases(h[::-1], [h[-1], *gap[::-1]])[::-1]
    place = np.searchsorted(tops, at)
    return p[at] - np.maximum(np.array(left), np.array(right))[place]


def apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which maxima stay when, from the highest on, each removes those nearer than ``distance``; of equal ones the later goes first."""
    keep = np.ones(len(at), bool)
    low, high = np.searchsorted(at, at - distance, side="right"), np.searchsorted(at, at + distance)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            keep[low[i] : i] = keep[i + 1 : high[i]] = False
    return keep


def significant(p: np.ndarray, snr: float, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``count`` highest maxima of at least ``snr`` standard deviations and the median prominence of such; their prominences; the deviation."""
    sigma = float(p.std())
    at = local_maxima(p)
    at = at[p[at] >= snr * sigma]
    rise = prominences(p, at)
    good = rise >= np.median(rise) if len(at) else np.zeros(0, bool)
    at, rise = at[good], rise[good]
    order = np.argsort(p[at], kind="stable")[::-1][:count]
    return at[order], rise[order], sigma


#: values at once, and maxima x points of a column up to which its prominences are found by direct search
DIRECT, COLUMN = 1 << 20, 50_000


def _rises(p: np.ndarray, at: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The prominence of each maximum ``at`` of its ``column`` by direct search."""
    place, out, some = np.arange(len(p))[:, None], np.empty(len(at)), max(1, DIRECT // len(p))
    for i in range(0, len(at), some):
        j, q = at[i : i + some], p[:, column[i : i + some]]
        height = q[j, np.arange(len(j))]
        higher, before = q > height, place <= j
        first, last = np.where(higher & before, place, -1).max(axis=0), np.where(higher & ~before, place, len(p)).min(axis=0)
        low, high = np.where(before & (place > first), q, np.inf).min(axis=0), np.where((place >= j) & (place < last), q, np.inf).min(axis=0)
        out[i : i + some] = height - np.maximum(low, high)
    return out


def highest(p: np.ndarray, snr: float) -> tuple[np.ndarray, np.ndarray]:
    """For each column the place that ``significant`` gives for one peak, or -1, and the deviation.

    The highest maximum is it if its own prominence is at least the median one. That one is exact: its bases
    are minima up to the next higher point. The others' prominence is at most their height over
    the higher of the minima to the left and to the right. Columns that this can't settle have all their prominences
    found, together; long ones, and such with a flat top, are looked at alone.
    """
    n, row = len(p), np.arange(p.shape[1])
    sigma = p.std(axis=0)
    if n < 3:
        return np.full(p.shape[1], -1), sigma
    top = np.zeros(p.shape, bool)
    top[1:-1] = (p[1:-1] > p[:-2]) & (p[1:-1] > p[2:]) & (p[1:-1] >= snr * sigma)
    flat = ((p[1:] == p[:-1]) & (p[1:] >= snr * sigma)).any(axis=0)
    best = np.where(top, p, -np.inf)[::-1].argmax(axis=0)
    best = n - 1 - best  # the last of equal ones
    height = p[best, row]
    base = np.maximum(np.minimum.accumulate(p, axis=0), np.minimum.accumulate(p[::-1], axis=0)[::-1])
    rise, count = height - base[best, row], top.sum(axis=0)
    beyond = np.flatnonzero((p.max(axis=0) > height) & (count > 0))  # by an end
    rise[beyond] = _rises(p, best[beyond], beyond)
    others = top.copy()
    others[best, row] = False
    under = 1 + (others & (p - base <= rise)).sum(axis=0)
    sure = ~flat & (count > 0) & (2 * under >= count + 1)
    out = np.where(sure, best, -1)
    open_ = np.flatnonzero(~sure & ~flat & (count > 0) & (count * n <= COLUMN))
    if len(open_):
        at, column = np.nonzero(top[:, open_])
        rises = np.full((n, len(open_)), np.inf)
        rises[at, column] = _rises(p, at, open_[column])
        ranked, c, own = np.sort(rises, axis=0), count[open_], np.arange(len(open_))
        good = top[:, open_] & (rises >= (ranked[(c - 1) // 2, own] + ranked[c // 2, own]) / 2)
        out[open_] = n - 1 - np.where(good, p[:, open_], -np.inf)[::-1].argmax(axis=0)
    sure[open_] = True
    for i in np.flatnonzero(~sure & ((count > 0) | flat)):
        at = significant(p[:, i], snr, 1)[0]
        out[i] = at[0] if len(at) else -1
    return out, sigma


def prominent(p: np.ndarray, distance: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` most prominent maxima: at least the 95th percentile high, ``distance`` apart, of 5 median absolute deviations of prominence."""
    at = local_maxima(p)
    at = at[p[at] >= np.percentile(p, 95)]
    at = at[apart(at, p[at], distance)]
    rise = prominences(p, at)
    good = rise >= 5 * np.median(np.abs(p - np.median(p)))
    at, rise = at[good], rise[good]
    order = np.argsort(rise, kind="stable")[::-1][:count]
    return at[order], rise[order]


def running_median(y: np.ndarray, half: int) -> np.ndarray:
    """Median of each value and ``half`` neighbours to each side, the ends repeated: one sorted window that slides."""
    padded = np.concatenate([np.full(half, y[0]), y, np.full(half, y[-1])]).tolist() if len(y) else []
    window, out = sorted(padded[: 2 * half + 1]), np.empty(len(y))
    for i in range(len(y)):
        out[i] = window[half]
        if i + 1 < len(y):
            del window[bisect_left(window, padded[i])]
            insort(window, padded[i + 2 * half + 1])
    return out


def background(y: np.ndarray, half: int, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Running median, and 1.4826 times the running median of the deviations from it, at least ``floor``."""
    mid = running_median(y, half)
    return mid, np.maximum(1.4826 * running_median(np.abs(y - mid), half), floor)


def candidates(f: float, harmonics: int, pmin: float, pmax: float) -> list[float]:
    """The period of ``f``, its multiples up to ``pmax``, its fractions down to ``pmin``."""
    n = range(2, harmonics + 1)
    return [1 / f, *(k / f for k in n if k / f <= pmax), *(1 / f / k for k in n if 1 / f / k >= pmin)]


def refined(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each row of frequencies and powers, the place of the parabola's top through the best three."""
    i = np.array([np.lexsort((x, y))[-1] for x, y in zip(f, p, strict=True)], int)
    row, inside = np.arange(len(f)), (i > 0) & (i < f.shape[1] - 1)
    j = np.clip(i, 1, f.shape[1] - 2)
    a, b, c = p[row, j - 1], p[row, j], p[row, j + 1]
    bend = a - 2 * b + c
    shift = np.where(inside & (bend != 0), 0.5 * (a - c) / np.where(bend != 0, bend, 1) * (f[row, j + 1] - f[row, j]), 0)
    return f[row, i] + shift
