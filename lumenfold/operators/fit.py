"""Small dense solves on trigonometric moments, many light curves at once.

What arrives here has a fixed size for each source, whatever its number of points:
sums over the points by band and order. ``n`` is the number of problems, ``B`` of
bands, ``M`` the order; coefficients are M cosines, then M sines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np


def harmonics(phi: np.ndarray, order: int) -> np.ndarray:
    x = 2 * np.pi * phi[:, None] * np.arange(1, order + 1)
    return np.hstack([np.cos(x), np.sin(x)])


def rotated(c: np.ndarray, s: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of cos k(x - angle) and sin k(x - angle) from those of cos kx and sin kx, k from 0 in the last axis."""
    turn = np.arange(c.shape[-1]) * angle[..., None]
    return c * np.cos(turn) + s * np.sin(turn), s * np.cos(turn) - c * np.sin(turn)


class Normal:
    """Centred normal equations of every problem and band: Gram matrix, right side, sum of squares, weight, means."""

    def __init__(self, c: np.ndarray, s: np.ndarray, yc: np.ndarray, ys: np.ndarray, yy: np.ndarray, order: int) -> None:
        gram = products(c, s, order)
        self.weight = np.maximum(c[..., 0], 1e-300)
        mean = np.concatenate([c[..., 1 : order + 1], s[..., 1 : order + 1]], -1)
        y = yc[..., 0] / self.weight
        self.gram = gram - mean[..., :, None] * mean[..., None, :] / self.weight[..., None, None]
        self.right = np.concatenate([yc[..., 1 : order + 1], ys[..., 1 : order + 1]], -1) - mean * y[..., None]
        self.squares = np.maximum(yy - yc[..., 0] * y, 0)
        self.mean_x, self.mean_y = mean / self.weight[..., None], y

    def level(self, coefficients: np.ndarray) -> np.ndarray:
        """The intercept that belongs to the coefficients of each problem and band."""
        return self.mean_y - (coefficients * self.mean_x).sum(-1)

    def misfit(self, coefficients: np.ndarray) -> np.ndarray:
        """Weighted squared residuals at the best intercept."""
        return np.maximum(self.squares - 2 * (coefficients * self.right).sum(-1) + np.einsum("...i,...ij,...j->...", coefficients, self.gram, coefficients), 0)


def descend(gram: np.ndarray, right: np.ndarray, lam: np.ndarray, box: np.ndarray, start: np.ndarray, tol: float = 1e-5, rounds: int = 300) -> np.ndarray:
    """min 1/2 b'Gb - r'b + lam |b|_1 with |b| <= box by cyclic coordinate descent, each problem with its own lam and box."""
    b = np.clip(start, -box[:, None], box[:, None])
    live = np.arange(len(b))
    for _ in range(rounds):
        if not len(live):
            break
        g, r, x, l, k = gram[live], right[live], b[live], lam[live], box[live]  # noqa: E741
        step = np.zeros(len(live))
        for j in range(b.shape[1]):
            own = g[:, j, j]
            rho = r[:, j] - np.einsum("ni,ni->n", g[:, j], x) + own * x[:, j]
            new = np.where(own > 1e-14, np.clip(np.sign(rho) * np.maximum(np.abs(rho) - l, 0) / np.maximum(own, 1e-14), -k, k), 0.0)
            step = np.maximum(step, np.abs(new - x[:, j]))
            x[:, j] = new
        b[live] = x
        live = live[step > tol * np.maximum(np.abs(x).max(axis=1), 1e-12)]
    b[np.abs(b) < 1e-7] = 0.0
    return b


def least_squares(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.einsum("nij,nj->ni", np.linalg.pinv(gram, rcond=1e-10, hermitian=True), right)


def peak_to_peak(coefficients: np.ndarray) -> np.ndarray:
    h = coefficients @ harmonics(np.linspace(0, 1, 1001), coefficients.shape[1] // 2).T
    low, high = np.percentile(h, [1, 99], axis=1)
    return np.maximum(high - low, 1e-6)


def box_bounds(bound: np.ndarray) -> tuple[Callable, Callable]:
    """Projection on |x| <= bound, and what of a descent direction's gradient stays inside there."""
    blocked = lambda x, g: ((x <= -bound) & (g > 0)) | ((x >= bound) & (g < 0))
    return lambda x: np.clip(x, -bound, bound), lambda x, g: np.where(blocked(x, g), 0, g)


def disc_bounds(bound: np.ndarray) -> tuple[Callable, Callable]:
    """The same for amplitudes: each order's cosine and sine coefficients stay on a disc of radius ``bound``."""

    def project(x: np.ndarray) -> np.ndarray:
        pair = x.reshape(len(x), 2, -1)
        size = np.hypot(pair[:, 0], pair[:, 1])
        return (pair * np.minimum(1, bound / np.maximum(size, 1e-300))[:, None]).reshape(x.shape)

    def inside(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        pair, slope = x.reshape(len(x), 2, -1), g.reshape(len(x), 2, -1)
        size = np.maximum(np.hypot(pair[:, 0], pair[:, 1]), 1e-300)
        out = (pair * slope).sum(1) / size  # along the radius
        held = (size >= bound * (1 - 1e-12)) & (out < 0)
        return (slope - np.where(held, out / size, 0)[:, None] * pair).reshape(g.shape)

    return project, inside


def coefficient_bounds(cfg, order: int) -> tuple[Callable, Callable]:
    """Bounds of the shape's coefficients: a number or one for each order, on coefficients (``ab``) or amplitudes (``AQ``)."""
    bound = np.broadcast_to(np.asarray(cfg.amp_harmonic, float), (cfg.m_max,) if np.ndim(cfg.amp_harmonic) else ())
    bound = bound[:order] if bound.ndim else np.full(order, bound)
    return disc_bounds(bound) if cfg.coef_mode == "AQ" else box_bounds(np.tile(bound, 2))


def minimise(f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, bounds: tuple[Callable, Callable], rounds: int = 80, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Projected quasi-Newton steps (BFGS) with halving, all problems side by side; ``f(x, which)`` gives values and gradients.

    ``bounds``: a projection on the allowed set and the part of a gradient that doesn't lead out of it.
    """
    project, inside = bounds
    x = project(x)
    n, d = x.shape
    value, slope = f(x, np.arange(n))
    inverse = np.tile(np.eye(d), (n, 1, 1))
    live, fresh = np.flatnonzero(np.isfinite(value)), np.ones(n, bool)
    for _ in range(rounds):
        if not len(live):
            break
        at, g, v = x[live], slope[live], value[live]
        held = inside(at, g)
        bounded = (held != g).any(axis=1)
        step = -inside(at, np.einsum("nij,nj->ni", inverse[live], held))
        uphill = (step * g).sum(1) >= 0
        step[uphill] = -held[uphill]
        inverse[live[uphill]] = np.eye(d)
        new, v_new, g_new, open_ = at.copy(), v.copy(), g.copy(), np.arange(len(live))
        for k in range(25):
            trial = project(at[open_] + 0.5**k * step[open_])
            tv, tg = f(trial, live[open_])
            good = tv <= v[open_] + 1e-4 * ((trial - at[open_]) * g[open_]).sum(1)
            new[open_[good]], v_new[open_[good]], g_new[open_[good]] = trial[good], tv[good], tg[good]
            open_ = open_[~good]
            if not len(open_):
                break
        s, y = new - at, g_new - g
        sy = (s * y).sum(1)
        fine = sy > 1e-12
        r = np.where(fine, 1 / np.where(fine, sy, 1), 0)
        left = np.eye(d) - r[:, None, None] * s[:, :, None] * y[:, None, :]
        moved = left @ inverse[live] @ np.swapaxes(left, 1, 2) + r[:, None, None] * s[:, :, None] * s[:, None, :]
        inverse[live[fine]] = moved[fine]
        x[live], value[live], slope[live] = new, v_new, g_new
        moves = v - v_new > tol * np.maximum(1, np.abs(v))
        again = ~moves & bounded & ~fresh[live]  # along an edge the curvature learned so far may mislead
        fresh[live] = again
        inverse[live[again]] = np.eye(d)
        live = live[moves | again]
    return x, value


@cache
def _second_difference(n_grid: int, order: int) -> np.ndarray:
    h = harmonics(np.arange(n_grid) / n_grid, order)
    return np.roll(h, -1, axis=0) - 2 * h + np.roll(h, 1, axis=0)


def spike(c: np.ndarray, n_grid: int, ratio: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """p99 of the model's |second circular difference| on a grid, squared, plus its mean square times ``ratio``; and the gradient."""
    second = _second_difference(n_grid, c.shape[1] // 2)
    d = c @ second.T
    order = np.argsort(np.abs(d), axis=1)
    place = 0.99 * (n_grid - 1)
    low, share = int(place), place - int(place)
    i, j, row = order[:, low], order[:, min(low + 1, n_grid - 1)], np.arange(len(c))
    top = (1 - share) * np.abs(d[row, i]) + share * np.abs(d[row, j])
    slope = (1 - share) * np.sign(d[row, i])[:, None] * second[i] + share * np.sign(d[row, j])[:, None] * second[j]
    return top**2 + ratio * (d**2).mean(1), 2 * top[:, None] * slope + 2 * ratio / n_grid * d @ second


class Sketch:
    """Points by fine phase bin and band, a fixed number for each problem, from which the slope penalty of any shape follows.

    All arrays are problems x entries: the mean phase, value and squared error of a bin's
    points, their count (0: no entry) and band. While a bin has one point this is the
    penalty over the points themselves.
    """

    def __init__(self, phi: np.ndarray, y: np.ndarray, e2: np.ndarray, count: np.ndarray, band: np.ndarray, cfg, order: int) -> None:
        self.phi, self.y, self.e2, self.count, self.band, self.cfg = phi, y, e2, count, band, cfg
        self.h = harmonics(phi.ravel(), order).reshape(*phi.shape, 2 * order)
        self.grid = harmonics(np.arange(cfg.n_grid) / cfg.n_grid, order)

    def penalty(self, c: np.ndarray, which: np.ndarray, amp: np.ndarray, m0: np.ndarray, d_amp: np.ndarray, d_m0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count-weighted Huber loss of the branch bins' mean deviations, and its gradient; ``d_``: by band, how the levels follow the shape."""
        cfg, n, bands = self.cfg, len(which), amp.shape[1]
        phi, count, band, h_row = self.phi[which], self.count[which], self.band[which], self.h[which]
        row = np.arange(n)
        h = np.einsum("nej,nj->ne", h_row, c)
        own_amp, own_m0 = np.take_along_axis(amp, band, 1), np.take_along_axis(m0, band, 1)
        most = amp.argmax(axis=1)
        top = amp[row, most]
        s = np.sqrt(self.e2[which] + (cfg.branch_error * top[:, None]) ** 2)
        r = self.y[which] - own_m0 - own_amp * h
        z = np.clip(r / s, -8, 8)
        curve = c @ self.grid.T
        ends = curve.argmin(axis=1) / cfg.n_grid, curve.argmax(axis=1) / cfg.n_grid
        groups, loss, total, pull = bands * cfg.branch_bins, np.zeros(n), np.zeros(n), np.zeros_like(z)
        for a, b in (ends, ends[::-1]):
            a, b = a[:, None], b[:, None]
            inside = np.where(a <= b, (phi >= a) & (phi <= b), (phi >= a) | (phi <= b)) & (count > 0)
            width = (b - a) % 1
            place = np.where(width > 0, (phi - a) % 1 / np.where(width > 0, width, 1), 0)
            group = band * cfg.branch_bins + np.clip(np.floor(place * cfg.branch_bins), 0, cfg.branch_bins - 1).astype(int)
            at, weight = (row[:, None] * groups + group).ravel(), np.where(inside, count, 0)
            points = np.bincount(at, weight.ravel(), n * groups).reshape(n, groups)
            mean = np.bincount(at, (weight * z).ravel(), n * groups).reshape(n, groups) / np.maximum(points, 1)
            used = (points >= 2) & (weight.sum(axis=1) >= cfg.branch_points)[:, None]
            size = np.abs(mean)
            huber = np.where(size <= cfg.huber_delta, 0.5 * mean**2, cfg.huber_delta * (size - cfg.huber_delta / 2))
            loss += np.where(used, points * huber, 0).sum(1)
            total += np.where(used, points, 0).sum(1)
            pull += weight * np.take_along_axis(np.where(used, np.clip(mean, -cfg.huber_delta, cfg.huber_delta), 0), group, 1)
        some = np.maximum(total, 1)
        pull = np.where(np.abs(r / s) < 8, pull, 0) / some[:, None]
        in_band = (band[..., None] == np.arange(bands)) * (pull / s)[..., None]
        slope = -np.einsum("nb,nbj->nj", in_band.sum(1), d_m0) - np.einsum("nb,nbj->nj", (in_band * h[..., None]).sum(1), d_amp)
        slope -= np.einsum("nb,neb,nej->nj", amp, in_band, h_row, optimize=True)
        slope -= ((pull * r / s**3).sum(1) * cfg.branch_error**2 * top)[:, None] * d_amp[row, most]
        return loss / some, slope


def shapes(normal: Normal, counts: np.ndarray, gaps: np.ndarray, most: np.ndarray, cfg, order: int, sketch: Sketch | None = None) -> dict[str, np.ndarray]:
    """The joint fit of every problem: start shapes by band, then all bands under the penalised objective.

    ``counts`` and ``gaps`` are by problem and band, ``most`` is the largest count of any
    band of the source; a band without points has 0 and
    takes no part. Intercepts and amplitudes are solved in closed form for every shape,
    so that the minimum is sought over the shape alone, first without the slope penalty, then
    from there with it. The epoch stays where it is: at
    a fixed period it only turns the phases.
    """
    n, bands = counts.shape
    there = counts > 0
    gap = np.where(there, gaps, 0).max(axis=1)
    lam = np.clip(cfg.lam[0] * (np.maximum(gap, 0.05) / 0.12) ** 3 * (order / 5) ** 2 * 30 / np.maximum(most, 10), cfg.lam[1], cfg.lam[2])
    gram, right = ((x / normal.weight.reshape(n, bands, *[1] * (x.ndim - 2))).reshape(n * bands, *x.shape[2:]) for x in (normal.gram, normal.right))
    wide = (gaps > 0.05).ravel()  # there the shape is held in its box; elsewhere shrunk
    plain = least_squares(gram, right)
    no_lasso = wide | (cfg.opt_method != "lasso")
    own = descend(gram, right, np.where(no_lasso, 0.0, np.repeat(lam, bands)), np.where(wide, np.max(cfg.amp_harmonic), np.inf), plain).reshape(n, bands, -1)
    scale = peak_to_peak(own.reshape(n * bands, -1)).reshape(n, bands)
    quality = np.where(there, normal.weight / np.maximum(normal.misfit(own), 1e-12 * normal.weight), 0)
    start = ((quality / scale)[..., None] * own).sum(axis=1) / np.maximum(quality.sum(axis=1), 1e-300)[:, None]
    dof = counts.sum(axis=1) - (2 * bands + 2 * order + 2)
    power = np.tile(np.arange(1, order + 1) ** cfg.power, 2)

    def levels(c: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
        gc = np.einsum("nbij,nj->nbi", normal.gram[which], c)
        cgc, cv = np.einsum("nbi,ni->nb", gc, c), np.einsum("nbi,ni->nb", normal.right[which], c)
        amp = np.clip(np.where(cgc > 1e-14, cv / np.maximum(cgc, 1e-14), cfg.amp[0]), *cfg.amp)
        return amp, normal.squares[which] - 2 * amp * cv + amp**2 * cgc, gc, cgc

    def smooth(c: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        amp, misfit, gc, _ = levels(c, which)
        own, free = there[which], np.maximum(dof[which], 1)
        chi = np.where(dof[which] > 0, np.where(own, misfit, 0).sum(1) / free, np.inf)
        slope = (np.where(own, amp, 0)[..., None] * 2 * (amp[..., None] * gc - normal.right[which])).sum(1) / free[:, None]
        rough, rough_slope = spike(c, cfg.n_grid)
        return chi + cfg.lam_spike * rough + cfg.lam_harmonic * (power * c * c).sum(1), slope + cfg.lam_spike * rough_slope + 2 * cfg.lam_harmonic * power * c

    def whole(c: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, slope = smooth(c, which)
        amp, _, gc, cgc = levels(c, which)
        free = (cgc > 1e-14) & (amp > cfg.amp[0]) & (amp < cfg.amp[1])
        d_amp = np.where(free[..., None], (normal.right[which] - 2 * amp[..., None] * gc) / np.maximum(cgc, 1e-14)[..., None], 0)
        mean = normal.mean_x[which]
        d_m0 = -amp[..., None] * mean - np.einsum("nbj,nj->nb", mean, c)[..., None] * d_amp
        amp_there = np.where(there[which], amp, 0)
        m0 = normal.mean_y[which] - amp * np.einsum("nbj,nj->nb", mean, c)
        branch, branch_slope = sketch.penalty(c, which, amp_there, m0, np.where(there[which][..., None], d_amp, 0), d_m0)
        return value + cfg.lam_slope * branch, slope + cfg.lam_slope * branch_slope

    bounds, every = coefficient_bounds(cfg, order), np.arange(n)
    objective = whole if sketch is not None and cfg.lam_slope else smooth
    if cfg.use_optim:
        c, value = minimise(smooth, start, bounds)
        if objective is whole:
            c, value = minimise(whole, c, bounds)
    else:
        c, value = start, objective(start, every)[0]
    amp, misfit, *_ = levels(c, every)
    chi = np.where(dof > 0, np.where(there, misfit, 0).sum(1) / np.maximum(dof, 1), np.inf)
    return {"objective": value, "chi2": chi, "shape": c, "m0": normal.level(amp[..., None] * c[:, None, :]), "amp": amp, "lam": lam, "dof": dof}


def products(c: np.ndarray, s: np.ndarray, order: int) -> np.ndarray:
    """Gram matrix of cosines and sines up to ``order`` from sums of cos kx and sin kx under any weight."""
    j = np.arange(1, order + 1)
    minus, plus = np.abs(j[:, None] - j), j[:, None] + j
    cos_cos, sin_sin = (c[..., minus] + c[..., plus]) / 2, (c[..., minus] - c[..., plus]) / 2
    cos_sin = (s[..., plus] + np.sign(j - j[:, None]) * s[..., minus]) / 2
    return np.concatenate([np.concatenate([cos_cos, cos_sin], -1), np.concatenate([np.swapaxes(cos_sin, -1, -2), sin_sin], -1)], -2)


def frequency_step(plain: list[np.ndarray], first: list[np.ndarray], second: list[np.ndarray], shape: np.ndarray, m0: np.ndarray, amp: np.ndarray, there: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Newton step in the frequency, shape and intercepts projected out, and the misfit's derivative.

    ``plain`` has the moments c, s, yc, ys of problems x bands, ``first`` those with one
    factor of the time, ``second`` c and s with two; ``shape`` is told from the time zero. ``ridge``: what the
    penalties add to the curvature of the shape's coefficients.
    """
    n, order = len(shape), shape.shape[1] // 2
    turn = 2 * np.pi * np.arange(1, order + 1)
    u = np.hstack([turn * shape[:, order:], -turn * shape[:, :order]])  # the shape's derivative, by cosines and sines
    w = np.where(there, amp, 0)
    own = lambda c, s: np.concatenate([c[..., 1 : order + 1], s[..., 1 : order + 1]], -1)
    tx, gram1 = own(*first[:2]), products(*first[:2], order)
    moved = np.einsum("nbij,nj->nbi", gram1, u)
    r = np.einsum("nbi,ni->nb", own(*first[2:]), u) - m0 * np.einsum("nbi,ni->nb", tx, u) - amp * np.einsum("nbi,ni->nb", moved, shape)
    pull = (w * r).sum(1)  # half the misfit's negative derivative
    ff = (w**2 * np.einsum("ni,nbij,nj->nb", u, products(*second, order), u)).sum(1)
    bands = amp.shape[1]
    k = np.zeros((n, bands + 2 * order, bands + 2 * order))
    k[:, range(bands), range(bands)] = np.where(there, plain[0][..., 0], 1)
    k[:, :bands, bands:] = w[..., None] * own(*plain[:2])
    k[:, bands:, :bands] = np.swapaxes(k[:, :bands, bands:], 1, 2)
    k[:, bands:, bands:] = np.einsum("nb,nbij->nij", w**2, products(*plain[:2], order))
    k[:, range(bands, bands + 2 * order), range(bands, bands + 2 * order)] += ridge
    cross = np.hstack([w * np.einsum("nbi,ni->nb", tx, u), np.einsum("nb,nbi->ni", w**2, moved)])
    curvature = ff - np.einsum("ni,ni->n", cross, np.einsum("nij,nj->ni", np.linalg.pinv(k, rcond=1e-12, hermitian=True), cross))
    return pull / np.maximum(curvature, 1e-6 * ff + 1e-300), -2 * pull
