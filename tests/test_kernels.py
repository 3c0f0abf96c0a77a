"""Numeric kernels against brute force, readers against files they have written."""

import numpy as np
import pytest

from lumenfold.config import EngineConfig
from lumenfold.operators import decompose, fit, jobs, periodogram, spectrum, stats
from lumenfold.sources import ecsv, epochs


def moments(t, y, w, period, order):
    k = 2 * np.pi * np.arange(2 * order + 1)[:, None] * t / period
    return [(np.cos(k) * w).sum(1), (np.sin(k) * w).sum(1), (np.cos(k) * w * y).sum(1), (np.sin(k) * w * y).sum(1), (w * y * y).sum()]


def curve(rng, n, period, noise=0.01):
    t = np.sort(rng.uniform(0, 30, n))
    phi = 2 * np.pi * t / period
    return t, 15 + 0.5 * (np.cos(phi) + 0.3 * np.cos(2 * phi + 1)) + rng.normal(0, noise, n)


def test_moments_hold_the_least_squares():
    rng = np.random.default_rng(0)
    t, y = curve(rng, 80, 1.3)
    w = rng.random(80) + 0.5
    normal = fit.Normal(*(np.array([[x]]) for x in moments(t, y - y.mean(), w, 1.3, 4)), 4)
    x = fit.harmonics((t / 1.3) % 1, 4)
    z = np.column_stack([np.ones(80), x]) * np.sqrt(w)[:, None]
    want = np.linalg.lstsq(z, (y - y.mean()) * np.sqrt(w), rcond=None)[0]
    got = fit.least_squares(normal.gram[0], normal.right[0])
    assert np.allclose(got[0], want[1:]) and np.allclose(normal.level(got[None])[0, 0], want[0])
    assert np.allclose(normal.misfit(got[None])[0, 0], ((z @ want - (y - y.mean()) * np.sqrt(w)) ** 2).sum())
    lam = 0.05
    gram, right = normal.gram[0] / w.sum(), normal.right[0] / w.sum()
    c = fit.descend(gram, right, np.array([lam]), np.array([np.inf]), got, tol=1e-12, rounds=5000)[0]
    slope = right[0] - gram[0] @ c
    assert np.all(np.abs(slope) <= lam + 1e-6) and np.allclose(slope[c != 0], lam * np.sign(c[c != 0]), atol=1e-6)
    turned = fit.rotated(*(m[None] for m in moments(t, y, w, 1.3, 4)[:2]), np.array([0.7]))
    k = np.arange(9)[:, None] * (2 * np.pi * t / 1.3 - 0.7)
    assert np.allclose(turned[0][0], (np.cos(k) * w).sum(1)) and np.allclose(turned[1][0], (np.sin(k) * w).sum(1))


def test_boxed_descent_is_optimal():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 6))
    gram, right, box = a.T @ a, a.T @ rng.normal(size=30) * 3, 0.2
    b = fit.descend(gram[None], right[None], np.zeros(1), np.array([box]), np.zeros((1, 6)), tol=1e-12, rounds=5000)[0]
    slope = gram @ b - right
    assert np.all(np.abs(b) <= box) and np.all(np.abs(slope[np.abs(b) < box]) < 1e-6) and np.all(slope[b == box] <= 1e-9) and np.all(slope[b == -box] >= -1e-9)


def test_minimise_and_spike():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 8, 4))
    goal = rng.normal(size=(5, 8))

    def f(x, which):
        r = np.einsum("nij,nj->ni", a[which], x) - goal[which]
        return (r * r).sum(1), 2 * np.einsum("nij,ni->nj", a[which], r)

    x, value = fit.minimise(f, np.zeros((5, 4)), fit.box_bounds(np.full(4, 10.0)), tol=1e-14)
    want = np.array([np.linalg.lstsq(p, g, rcond=None)[0] for p, g in zip(a, goal, strict=True)])
    assert np.allclose(x, want, atol=1e-5) and np.allclose(value, [((p @ w - g) ** 2).sum() for p, w, g in zip(a, want, goal, strict=True)])
    c = rng.normal(size=(3, 6))
    value, slope = fit.spike(c, 50)
    h = c @ fit.harmonics(np.arange(50) / 50, 3).T
    d = np.roll(h, -1, 1) - 2 * h + np.roll(h, 1, 1)
    assert np.allclose(value, np.percentile(np.abs(d), 99, axis=1) ** 2 + 0.05 * (d**2).mean(1))
    for j in range(6):
        step = np.zeros(6)
        step[j] = 1e-6
        assert np.allclose((fit.spike(c + step, 50)[0] - fit.spike(c - step, 50)[0]) / 2e-6, slope[:, j], atol=1e-4)


def test_joint_fit_beats_its_start():
    rng, cfg = np.random.default_rng(3), EngineConfig(m_max=5)
    bands = [curve(rng, 25, 1.3) for _ in range(3)]
    sums = [moments(t, y - y.mean(), np.full(25, 1e4), 1.3, 5) for t, y in bands]
    normal = lambda: fit.Normal(*(np.array([[s[i] for s in sums]]) for i in range(5)), 5)
    counts, gaps = np.full((1, 3), 25.0), np.full((1, 3), 0.1)
    got = fit.shapes(normal(), counts, gaps, counts.max(axis=1), cfg, 5)
    plain = fit.shapes(normal(), counts, gaps, counts.max(axis=1), EngineConfig(m_max=5, use_optim=False), 5)
    assert got["objective"][0] <= plain["objective"][0] + 1e-9
    # the objective from the points
    c, chi = got["shape"][0], 0.0
    for j, (t, y) in enumerate(bands):
        r = y - y.mean() - got["m0"][0, j] - got["amp"][0, j] * (fit.harmonics((t / 1.3) % 1, 5) @ c)
        chi += 1e4 * (r * r).sum()
    chi /= 75 - 18
    penalty = cfg.lam_spike * fit.spike(c[None], 50)[0][0] + 10 * (np.tile(np.arange(1, 6) ** 4.0, 2) * c * c).sum()
    assert got["chi2"][0] == pytest.approx(chi, rel=1e-6) and got["objective"][0] == pytest.approx(chi + penalty, rel=1e-6)
    assert np.isinf(fit.shapes(normal(), np.full((1, 3), 5.0), gaps, np.full(1, 5.0), cfg, 5)["chi2"][0])


def branch_penalty(phi, y, e, band, c, m0, amp, cfg):
    """The slope penalty over points, as it is defined."""
    order = len(c) // 2
    z = np.clip((y - m0[band] - amp[band] * (fit.harmonics(phi, order) @ c)) / np.sqrt(np.maximum(e, cfg.err_floor) ** 2 + (cfg.branch_error * amp.max()) ** 2), -8, 8)
    grid = np.arange(cfg.n_grid) / cfg.n_grid
    h = fit.harmonics(grid, order) @ c
    peak, trough = grid[h.argmin()], grid[h.argmax()]
    loss, count = 0.0, 0
    for a, b in ((peak, trough), (trough, peak)):
        inside = (phi >= a) & (phi <= b) if a <= b else (phi >= a) | (phi <= b)
        if inside.sum() < cfg.branch_points:
            continue
        place = np.clip(np.floor((phi - a) % 1 / ((b - a) % 1) * cfg.branch_bins), 0, cfg.branch_bins - 1)
        for g in {(i, j) for i, j in zip(band[inside], place[inside], strict=True)}:
            own = inside & (band == g[0]) & (place == g[1])
            if own.sum() >= 2:
                m = abs(z[own].mean())
                loss += own.sum() * (0.5 * m * m if m <= cfg.huber_delta else cfg.huber_delta * (m - cfg.huber_delta / 2))
                count += own.sum()
    return loss / count if count else 0.0


def sketched(rng, n=60, order=4, cfg=EngineConfig(m_max=4, lam_slope=0.5)):
    phi = (rng.permutation(200)[:n] + rng.random(n)) / 200
    band, e = rng.integers(0, 3, n), rng.uniform(0.01, 0.05, n)
    y = 0.4 * np.cos(2 * np.pi * phi) + 0.2 * np.cos(4 * np.pi * phi + 1) + rng.normal(0, 0.05, n) + 0.1 * (phi > 0.7)
    one = np.ones((1, n))
    return phi, band, e, y, fit.Sketch(phi[None], y[None], np.maximum(e, cfg.err_floor)[None] ** 2, one, band[None], cfg, order), cfg


def test_branch_sketch_is_the_penalty_and_its_slope():
    rng = np.random.default_rng(11)
    for _ in range(20):
        phi, band, e, y, sketch, cfg = sketched(rng)
        c, which = rng.normal(0, 0.3, 8), np.zeros(1, int)
        m_of, a_of = rng.normal(size=(3, 8)), rng.normal(size=(3, 8))
        levels = lambda c, m_of=m_of, a_of=a_of: (0.1 * m_of @ c, 0.6 + 0.1 * a_of @ c)

        def value(c, sketch=sketch, which=which, m_of=m_of, a_of=a_of, levels=levels):
            m0, amp = levels(c)
            return sketch.penalty(c[None], which, amp[None], m0[None], 0.1 * a_of[None], 0.1 * m_of[None])

        got, slope = value(c)
        assert got[0] == pytest.approx(branch_penalty(phi, y, e, band, c, *levels(c), cfg), rel=1e-9)
        numeric = [(value(c + d)[0] - value(c - d)[0])[0] / 2e-7 for d in np.eye(8) * 1e-7]
        assert np.allclose(numeric, slope[0], atol=2e-5)


def test_slope_bends_the_shape():
    """With the penalty in the optimiser the whole objective, told from the points, is never above that of the shape fitted without."""
    rng, better = np.random.default_rng(12), 0
    for _ in range(15):
        phi, band, e, y, sketch, cfg = sketched(rng)
        order, w = 4, 1 / np.maximum(e, cfg.err_floor) ** 2
        k = 2 * np.pi * np.arange(2 * order + 1)[:, None] * phi
        sums = [np.array([[(f * own).sum(1) for own in ((band == b) * w for b in range(3))]]) for f in (np.cos(k), np.sin(k), np.cos(k) * y, np.sin(k) * y)]
        yy = np.array([[((band == b) * w * y * y).sum() for b in range(3)]])
        counts = np.array([[(band == b).sum() for b in range(3)]], float)
        run = lambda s, sums=sums, yy=yy, counts=counts, cfg=cfg: fit.shapes(fit.Normal(*sums, yy, 4), counts, np.full((1, 3), 0.04), counts.max(axis=1), cfg, 4, s)
        with_, without = run(sketch), run(None)
        branch = lambda r, phi=phi, y=y, e=e, band=band, cfg=cfg: branch_penalty(phi, y, e, band, r["shape"][0], r["m0"][0], r["amp"][0], cfg)
        before = without["objective"][0] + cfg.lam_slope * branch(without)
        smooth = with_["chi2"][0] + cfg.lam_spike * fit.spike(with_["shape"], cfg.n_grid)[0][0] + cfg.lam_harmonic * (np.tile(np.arange(1, 5) ** 4.0, 2) * with_["shape"][0] ** 2).sum()
        assert with_["objective"][0] == pytest.approx(smooth + cfg.lam_slope * branch(with_), rel=1e-6) and with_["objective"][0] <= before + 1e-9
        better += with_["objective"][0] < before - 1e-5
    assert better > 5


def test_amplitude_bounds_are_optimal():
    rng = np.random.default_rng(13)
    a, goal, bound = rng.normal(size=(6, 20, 6)), rng.normal(size=(6, 20)) * 3, np.array([0.5, 0.2, 0.05])

    def f(x, which):
        r = np.einsum("nij,nj->ni", a[which], x) - goal[which]
        return (r * r).sum(1), 2 * np.einsum("nij,ni->nj", a[which], r)

    x, _ = fit.minimise(f, rng.normal(size=(6, 6)), fit.disc_bounds(bound), rounds=500, tol=1e-15)
    slope, size = f(x, np.arange(6))[1], np.hypot(x[:, :3], x[:, 3:])
    assert np.all(size <= bound + 1e-12) and (np.abs(size - bound) < 1e-9).any()
    for n in range(6):
        for j in range(3):
            g, p = slope[n, [j, j + 3]], x[n, [j, j + 3]]
            if size[n, j] < bound[j] - 1e-9:
                assert np.abs(g).max() < 1e-3  # inside: flat
            else:
                assert abs(g[0] * p[1] - g[1] * p[0]) < 1e-3 and g @ p <= 1e-9  # at the edge: straight out
    cfg = EngineConfig(m_max=3, coef_mode="AQ", amp_harmonic=(0.5, 0.2, 0.05))
    project, _ = fit.coefficient_bounds(cfg, 2)
    assert np.allclose(project(np.array([[3.0, 0.1, 4.0, 0.1]])), [[0.3, 0.1, 0.4, 0.1]])
    assert np.allclose(fit.coefficient_bounds(EngineConfig(), 2)[0](np.array([[3.0, 0.1, -4.0, 0.1]])), [[1.5, 0.1, -1.5, 0.1]])
    for bad in ({"coef_mode": "x"}, {"tie_breaker": "x"}, {"amp_harmonic": (1.0,)}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_frequency_step_is_the_slope_of_the_misfit():
    rng = np.random.default_rng(14)
    t, y, w = np.sort(rng.uniform(0, 30, 50)), rng.normal(size=50), rng.random(50) + 0.5
    shape, m0, amp = rng.normal(size=(1, 6)), rng.normal(size=(1, 1)), np.array([[0.7]])

    def misfit(f):
        return (w * (y - m0[0, 0] - amp[0, 0] * (fit.harmonics(f * t, 3) @ shape[0])) ** 2).sum()

    f, k = 0.73, 2 * np.pi * np.arange(7)[:, None] * 0.73 * t
    sums = lambda v: [np.array([[(g(k) * v).sum(1)]]) for g in (np.cos, np.sin)]
    _, slope = fit.frequency_step(sums(w), [*sums(w * t), *sums(w * t * y)], sums(w * t * t), shape, m0, amp, np.ones((1, 1), bool), np.zeros(6))
    assert slope[0] == pytest.approx((misfit(f + 1e-7) - misfit(f - 1e-7)) / 2e-7, rel=1e-5)


def test_free_periods(spark):
    """Periods one per cent off come back to 1e-5 of the truth; one that is further off than the bounds stays within them."""
    rng, cfg, rows = np.random.default_rng(15), EngineConfig(m_max=5, pmin=0.5, period_fit=True), []
    truth = {"a": 1.37, "b": 2.9, "c": 0.83}
    for name, period in truth.items():
        t, y = curve(rng, 90, period, noise=0.0002)
        rows += [(name, ("g", "bp", "rp")[i % 3], float(t[i]), float(y[i]), 0.001, i) for i in range(90)]
    d = spark.createDataFrame(rows, "source_id string, band string, t double, mag double, emag double, ord long")
    given = spark.createDataFrame([("a", 0, 1.37 * 1.01, None), ("b", 0, 2.9 * 0.99, None), ("c", 0, 0.83 * 1.01, None), ("c", 1, 0.83 * 1.3, None)], "source_id string, cand int, P double, Z double")
    got = {r["ID"]: r for r in decompose.fourier_decomposition(d, cfg, given).collect()}
    assert {k: abs(got[k]["P"] / p - 1) < 1e-5 for k, p in truth.items()} == dict.fromkeys(truth, True)
    assert got["a"]["P0"] == 1.37 * 1.01 and all(r["E"] >= 0 for r in got.values())
    moved = {(r["source_id"], r["cand"]): r["P"] for r in decompose.free_periods(decompose.clean_points(d, cfg), given, cfg).collect()}
    assert len(moved) == 4 and 0.9 <= moved["c", 1] / (0.83 * 1.3) <= 1.1 and abs(moved["c", 0] / 0.83 - 1) < 1e-5


def test_injected_periods_are_recovered(spark):
    rng, cfg, rows = np.random.default_rng(1), EngineConfig(m_max=5, pmin=0.5), []
    truth = {"a": 1.37, "b": 2.9, "c": 0.83}
    for name, period in truth.items():
        t, y = curve(rng, 75, period)
        rows += [(name, ("g", "bp", "rp")[i % 3], float(t[i]), float(y[i]), 0.01, i) for i in range(75)]
    rows += [("few", "g", float(i), 15.0 + i % 2, 0.01, i) for i in range(6)] + [("none", "x", 1.0, 15.0, 0.1, 0), ("bad", "g", 1.0, float("nan"), 0.1, 0)]
    d = spark.createDataFrame(rows, "source_id string, band string, t double, mag double, emag double, ord long")
    labels = spark.createDataFrame([("a", "RRab")], "source_id string, pulsation string")
    got = {r["ID"]: r for r in decompose.fourier_decomposition(d, cfg, labels=labels).collect()}
    assert set(got) == set(truth) and got["a"]["pulsation"] == "RRab" and got["b"]["pulsation"] is None
    assert all(abs(got[k]["P"] / p - 1) < 0.01 and cfg.m_min <= got[k]["M_fit"] <= 5 and got[k]["flag"] == 0 and got[k]["rms_g"] < 0.03 for k, p in truth.items())
    given = decompose.template_start(spark.createDataFrame([("a", 1.37, 1), ("b", 2.9, 9)], "ID string, P double, T int"), spark.createDataFrame([("T1",)], "name string"))
    start = decompose.fourier_decomposition(d.repartition(3), cfg, given).collect()
    assert [r["ID"] for r in start] == ["a"] and start[0]["P"] == 1.37 and start[0]["Zmax"] is None
    quality = jobs.quality_table(d, decompose.fourier_decomposition(d, cfg), cfg).collect()
    assert len(quality) == 9 and all(q["N"] == 25 and len(q["residual_grid"]) == len(q["fval_grid"]) == 50 and sum(q["phase_mask"]) == round(50 * q["occupied_fraction"]) for q in quality)
    plan, meta = jobs.build_plan(d, cfg)
    assert {r["source_id"] for r in meta.collect()} >= set(truth) and plan.count() == sum(r["n_jobs"] for r in meta.collect())
    assert decompose.fourier_decomposition(d.limit(0), cfg).count() == 0


def test_peaks_against_definitions():
    rng = np.random.default_rng(5)
    p = np.round(rng.random(300) * 20) / 4
    at = spectrum.local_maxima(p)
    runs = [(i, j) for i in range(1, 299) for j in range(i, 299) if len(set(p[i : j + 1])) == 1 and p[i - 1] < p[i] and p[j + 1] < p[i]]
    assert at.tolist() == [(i + j) // 2 for i, j in runs]
    rise = spectrum.prominences(p, at)
    for i, r in zip(at, rise, strict=True):
        a, b = i, i
        while a > 0 and p[a - 1] <= p[i]:
            a -= 1
        while b < 299 and p[b + 1] <= p[i]:
            b += 1
        assert r == p[i] - max(p[a : i + 1].min(), p[i : b + 1].min())
    keep = at[spectrum.apart(at, p[at], 10)]
    assert np.diff(keep).min() >= 10 and p[at].max() in p[keep]


def test_recurrences_and_backgrounds():
    rng = np.random.default_rng(6)
    t, y, w, band = np.sort(rng.uniform(0, 400, 60)), rng.normal(size=60), rng.random(60) + 0.5, rng.integers(0, 3, 60)
    curve = spectrum.Curve(t, y, w, band, 4)
    f = 1 / 300 + np.arange(1300) / 800
    first, second = (np.concatenate(x, axis=1) for x in zip(*((a, b) for _, a, b in curve.blocks(1 / 300, 1 / 800, 1300)), strict=True))
    assert np.allclose(first, curve.at(f)[0], atol=1e-9) and np.allclose(second, curve.at(f)[1], atol=1e-9)
    p = spectrum.power(curve.totals, first, second)[:, 0]
    want, total = np.zeros(1300), 0.0
    for b in range(3):  # least squares by band
        own = band == b
        root = np.sqrt(w[own])
        flat = (root**2 * (y[own] - np.average(y[own], weights=w[own])) ** 2).sum()
        for k, x in enumerate(f):
            z = np.column_stack([np.ones(own.sum()), np.cos(2 * np.pi * x * t[own]), np.sin(2 * np.pi * x * t[own])]) * root[:, None]
            want[k] += flat - ((z @ np.linalg.lstsq(z, y[own] * root, rcond=None)[0] - y[own] * root) ** 2).sum()
        total += flat
    assert np.allclose(p, want / total, atol=1e-8)
    values, own_f = rng.normal(size=(60, 3)), rng.uniform(0.1, 2, (3, 5))
    values = values[np.argsort(band, kind="stable")]
    for i in range(3):
        alone = spectrum.Curve(curve.t, values[:, i], curve.w, np.sort(band), 4)
        sums = [alone.totals[:, 2, None], alone.totals[:, 3, None]]
        assert np.allclose(curve.own_power(own_f[i : i + 1], values[:, i : i + 1], sums)[0], spectrum.power(alone.totals, *alone.at(own_f[i]))[:, 0])
    many = np.hstack([rng.random((60, 200)), np.round(rng.random((60, 200)) * 4), rng.random((60, 100)) ** 8, np.zeros((60, 1)), np.linspace(0, 1, 60)[:, None]])
    many[0, :50] = 1.5  # ends that are higher than all maxima
    for snr in (0.5, 2.0, 4.0):
        place, sigma = spectrum.highest(many, snr)
        for i in range(many.shape[1]):
            at, _, own = spectrum.significant(many[:, i], snr, 1)
            assert place[i] == (at[0] if len(at) else -1) and sigma[i] == pytest.approx(own)
    assert spectrum.highest(many[:2], 1.0)[0].max() == -1
    q = rng.random(500)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(q, 100, mode="edge"), 201)
    mid, sig = spectrum.background(q, 100)
    assert np.allclose(mid, np.median(windows, axis=1))
    assert np.allclose(sig, np.maximum(1.4826 * np.median(np.lib.stride_tricks.sliding_window_view(np.pad(np.abs(q - mid), 100, mode="edge"), 201), axis=1), 1e-6))
    assert (spectrum.background(np.ones(5), 2)[1] == 1e-6).all() and len(spectrum.running_median(np.zeros(0), 3)) == 0


def test_long_curves_in_parts(spark):
    """A source in one row or in many has the same powers and periods, also over a long span; the plan has no row for each frequency."""
    rng, rows = np.random.default_rng(8), []
    for name, period, span in (("a", 1.37, 60), ("b", 0.61, 900)):
        t = np.sort(rng.uniform(0, span, 300))
        y = 15 + 0.4 * np.cos(2 * np.pi * t / period) + rng.normal(0, 0.02, 300)
        rows += [(name, ("g", "bp", "rp")[i % 3], float(t[i]), float(y[i]), 0.02, i) for i in range(300)]
    d = spark.createDataFrame(rows, "source_id string, band string, t double, mag double, emag double, ord long").repartition(3)
    whole, parts = periodogram.curves(d), periodogram.curves(d, points=40)
    assert whole.count() == 2 and parts.count() == 16
    for window in (False, True):
        one, many = ({r["source_id"]: np.array(r["power"]) for r in periodogram.spectra(x, window).collect()} for x in (whole, parts))
        assert all(np.allclose(one[k], many[k], atol=1e-9) for k in "ab") and len(one["b"]) > 8000
    want = {(r["source_id"], r["cand"]): (r["P"], r["Z"]) for r in periodogram.search_periods(d, EngineConfig()).collect()}
    got = {(r["source_id"], r["cand"]): (r["P"], r["Z"]) for r in periodogram.search_periods(d, EngineConfig(), points=40).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
    assert abs(want["b", 0][0] / 0.61 - 1) < 1e-4
    plan = periodogram.pick_peaks(periodogram.spectra(whole), "power", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_injection(spark):
    rng, rows = np.random.default_rng(1), []
    for s in ("a", "b"):
        t, y = curve(rng, 60, 1.0)
        rows += [(s, ("g", "bp")[i % 2], float(t[i]), float(y[i]), 0.01, i) for i in range(60)]
    d = spark.createDataFrame(rows, "source_id string, band string, t double, mag double, emag double, ord long")
    cfg, kinds = EngineConfig(m_max=5, pmax=6.0), [("T1", [1.0, 0.4], [0.2, 1.1]), ("T2", [1.0], [0.0])]
    got = jobs.injection_recovery(d, kinds, cfg, periods=100, repeats=3).collect()
    again = jobs.injection_recovery(d.repartition(5), kinds, cfg, periods=100, repeats=3).collect()
    assert len(got) == 1200 and sorted(map(str, got)) == sorted(map(str, again))
    alone = jobs.injection_recovery(d, kinds[1:], cfg, periods=20, repeats=1).collect()
    assert set(map(str, alone)) < set(map(str, got))  # a trial doesn't depend on the others
    assert len({r["P_true"] for r in got}) == 1200 and all(0.2 <= r["P_true"] <= 6 for r in got)
    assert sum(abs(r["rel_err"] or 9) < 0.01 for r in got) > 1000


def test_run_jobs(spark, tmp_path):
    plan = spark.createDataFrame([("s", "s_gbp_00", [0, 1], 0.5, 0, 0.2, 1.0, 0.05, 3.0, 1, 25), ("s", "s_gbp_01", [0, 1, 2], 0.5, 0, 0.2, 1.0, 0.05, 3.0, 1, 25)], "source_id string, job_id string, bands array<int>, P0 double, p0flag int, pmin double, pmax double, Amin double, Amax double, tmpl_start int, tmpl_end int")
    got = {r["job_id"]: r for r in jobs.run_jobs(plan, ["sh", "-c", "printf 'P T\\n1 2\\n%s 4\\n' $(tail -1 lomb_scargle.txt | cut -d' ' -f2) > out.txt"], output="out.txt").collect()}
    assert got["s_gbp_00"]["result"] == "P=0.5000000000 T=4" and got["s_gbp_00"]["returncode"] == 0 and got["s_gbp_01"]["returncode"] == -999
    slow = jobs.run_jobs(plan.limit(1), ["sleep", "5"], timeout=1).first()
    assert slow["returncode"] == -9 and jobs.run_jobs(plan.limit(1), ["no-such-program"]).first()["returncode"] == -999
    jobs.save_plan(plan, plan.select("source_id").distinct(), str(tmp_path / "plan"))
    own, meta = jobs.load_plan(spark, str(tmp_path / "plan"), spark.createDataFrame([("s",), ("t",)], "source_id string"))
    assert own.count() == 2 and meta.count() == 1


def test_capped_clusters(spark):
    p = spark.createDataFrame([(1, 1.0), (1, 1.05), (1, 1.1), (1, 1.16), (1, 5.0), (1, 0.0), (1, float("nan")), (1, float("inf"))], "source_id int, period double")
    assert sorted(r["n"] for r in periodogram.cluster_periods(p, 0.03).collect()) == [1, 4]
    assert sorted(r["n"] for r in periodogram.cluster_periods(p, 0.03, max_width=0.09).collect()) == [1, 2, 2]


def test_fitlc_round_trip(spark, tmp_path):
    rows = [(f"s{i}", ("g", "bp", "rp")[k % 3], k + 0.5, 12.25 + i, 0.01) for i in range(40) for k in range(5)] + [("s0", "x", 0.0, 0.0, 0.0)]
    e = spark.createDataFrame(rows, "source_id string, band string, t double, mag double, emag double")
    epochs.write_fitlc(e, str(tmp_path / "lc"), ("g", "bp", "rp"), bucket=60)
    files = list((tmp_path / "lc" / "curves").rglob("*.txt"))
    assert 1 < len(files) <= 4  # buckets, not sources
    got = epochs.read_fitlc(spark, str(tmp_path / "lc"), ("g", "bp", "rp")).collect()
    assert sorted(tuple(r) for r in got) == sorted(rows[:-1])
    few = epochs.read_fitlc(spark, str(tmp_path / "lc"), ("g", "bp", "rp"), ["s3", "none"])
    assert sorted(tuple(r) for r in few.collect()) == sorted(r for r in rows if r[0] == "s3")
    assert spark.read.parquet(str(tmp_path / "lc" / "index")).where("source_id = 's3'").first()["points"] == 5
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "a.fitlc").write_text(epochs.curve_file(["0 1.5 12.25 0.01", "2 2.5 11.0 0.02"]))
    single = epochs.read_fitlc(spark, str(tmp_path / "own"), ("g", "bp", "rp")).orderBy("t").collect()
    assert [tuple(r) for r in single] == [("a", "g", 1.5, 12.25, 0.01), ("a", "rp", 2.5, 11.0, 0.02)]


def test_runs_resume(spark, tmp_path):
    """A run that stops in the middle goes on with the jobs that are left; whole waves are never run again."""
    plan = spark.createDataFrame([(f"s{i % 4}", f"j{i}", i % 3, "gbp", 0.5, 0.2, 1.0, 1) for i in range(12)], "source_id string, job_id string, window_idx int, bandpair string, P0 double, pmin double, pmax double, p0flag int")
    mark, log = tmp_path / "ran", str(tmp_path / "log")
    mark.mkdir()
    script = f"echo x >> {mark}/{{job_id}}; [ {{job_id}} != j7 ] && echo ok"
    calls, write = [], jobs.run_jobs

    def dies(*a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return write(*a, **k)

    jobs.run_jobs = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            jobs.run_plan(plan, ["sh", "-c", script], log, wave=3)
    finally:
        jobs.run_jobs = write
    first = {r["job_id"] for r in jobs.read_log(spark, log).collect()}
    assert 0 < len(first) < 12
    (tmp_path / "log" / "wave-0-9").mkdir()  # a wave that was cut off
    got = {r["job_id"]: r for r in jobs.run_plan(plan, ["sh", "-c", script], log, wave=5).collect()}
    assert len(got) == 12 and all((mark / j).read_text() == "x\n" for j in got)  # each job once
    assert not got["j7"]["result_ok"] and got["j1"]["result"] == "ok" and got["j1"]["P0"] == 0.5
    again = {r["job_id"]: r for r in jobs.run_plan(plan, ["sh", "-c", script.replace("!= j7", "!= j0")], log, retry=True).collect()}
    assert len(again) == 12 and again["j7"]["result_ok"] and (mark / "j7").read_text() == "x\nx\n" and (mark / "j1").read_text() == "x\n"
    total = {r["source_id"]: (r["n_jobs_total"], r["n_jobs_finished"], r["n_jobs_success"]) for r in jobs.source_log(plan, jobs.read_log(spark, log)).collect()}
    assert total == dict.fromkeys(("s0", "s1", "s2", "s3"), (3, 3, 3))


def test_result_files(spark, tmp_path):
    """Decomposition rows as text under their header, appended, and a quality table with its arrays."""
    cfg = EngineConfig(m_max=2)
    schema = decompose.fd_schema(cfg, "string")
    names = [x.split()[0] for x in schema.split(", ")]
    assert len(names) == 11 + 6 * 3 + 2 * 2 and names[:3] == ["ID", "pulsation", "N_g"] and names[-1] == "flag"
    row = [("a" if c == "ID" else "RR" if c == "pulsation" else None if c == "phi_rise" else 3 if c[:2] in ("N_", "M_") or c == "flag" else 0.1 + i) for i, c in enumerate(names)]
    for name in ("a", "b"):
        epochs.write_fd(spark.createDataFrame([[name, *row[1:]]], schema), str(tmp_path / "fd"))
    head = {p.read_text().split("\n")[0] for p in (tmp_path / "fd").glob("part*")}
    assert head == {" ".join(names)}
    got = epochs.read_fd(spark, str(tmp_path / "fd"), schema).orderBy("ID").collect()
    assert [tuple(r) for r in got] == [("a", *row[1:]), ("b", *row[1:])]
    d = spark.createDataFrame([("a", "g", 0.1 * i, 15.0, 0.1, i) for i in range(9)], "source_id string, band string, t double, mag double, emag double, ord long")
    fd = got[0].asDict() | {"P": 1.0, "E": 0.0}
    table = jobs.quality_table(d, spark.createDataFrame([tuple(fd[c] for c in names)], schema), cfg)
    epochs.write_quality(table, str(tmp_path / "quality"))
    back = spark.read.parquet(str(tmp_path / "quality")).collect()
    assert back == table.collect() and len(back[0]["phase_mask"]) == 50 and back[0]["N"] == 9


def test_ogle_layout_and_idents(spark, tmp_path):
    (tmp_path / "cat" / "I").mkdir(parents=True)
    (tmp_path / "cat" / "I" / "S-1.dat").write_text("1.0 15.0 0.1\n2.0 15.5 0.1\n")
    got = epochs.read_ogle(spark, str(tmp_path)).collect()
    assert {(r["source_id"], r["band"]) for r in got} == {("S-1", "I")} and len(got) == 2
    (tmp_path / "lmc_dsct_ident.dat").write_text("S-1  RRab \n")
    ident = epochs.read_ogle_ident(spark, [str(tmp_path / "lmc_dsct_ident.dat")], [("ID", 1, 5), ("pulsation", 6, 5)]).first()
    assert (ident["ID"], ident["pulsation"], ident["catalogue"]) == ("S-1", "RRab", "lmc_dsct")
    with pytest.raises(ValueError):
        EngineConfig(mode="other")


def test_constant_residuals_have_no_correlation(spark):
    r = spark.createDataFrame([(1, "g", i / 10, 1.0, 0.1, i) for i in range(8)], "source_id int, band string, phi double, residual double, emag double, ord int")
    assert stats.residual_autocorrelation(r, 5).first()["rho"] == 0.0


ECSV = "# %ECSV 1.0\n# ---\n# delimiter: '{0}'\n# datatype:\n# - {{name: variability_flag_g_reject, datatype: bool}}\n# - {{name: solution_id, datatype: int64, description: 'a, b'}}\n# - {{name: bp_obs_time, unit: d, datatype: float64}}\n# - name: bp_flux\n#   datatype: float64\n# - {{name: bp_mag, datatype: float32}}\n# - {{name: rp_obs_time, datatype: float64}}\n# - {{name: bp_flux_error, datatype: float64}}\n# - {{name: variability_flag_bp_reject, datatype: bool}}\n# schema: astropy-2.0\n"


@pytest.mark.parametrize("sep", [" ", ","])
def test_files_by_name(spark, tmp_path, sep):
    """Any order of columns, further and absent ones, masked cells, and bad files."""
    names = ["variability_flag_g_reject", "solution_id", "bp_obs_time", "bp_flux", "bp_mag", "rp_obs_time", "bp_flux_error", "variability_flag_bp_reject"]
    lines = [["False", "1", "1.5", "100.0", "15.0", "1.6", "1.0", "False"], ["False", "1", "2.5", "90.0", '""', "2.6", "1.0", "False"], ["True", "1", "3.5", "80.0", "15.2", '""', '""', "True"]]
    whole = ECSV.format(sep) + "\n".join(sep.join(x) for x in [names, *lines]) + "\n"
    (tmp_path / "epphot_DR3_5.ecsv").write_text(whole)
    order = [2, 7, 0, 6, 5, 3, 4, 1]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "epphot_DR3_6.ecsv").write_text("# a comment\n" + "\n".join(" ".join(x[i] for i in order) for x in [names, *lines]))
    (tmp_path / "epphot_DR3_7.ecsv").write_text(whole.replace("bp_obs_time", "other_time"))
    (tmp_path / "epphot_DR3_8.ecsv").write_text(whole.replace("90.0", "ninety"))
    (tmp_path / "epphot_DR3_9.ecsv").write_text("\n# only a comment\n")
    (tmp_path / "epphot_DR3_10.ecsv").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "epphot_DR3_11.ecsv").write_text(whole + "1 2\n")
    (tmp_path / "epphot_DR3_12.ecsv").write_text(whole.replace("name: solution_id", "name: solution"))
    files = epochs.survey_files(spark, "gaia", str(tmp_path))
    good = files.where("error is null").orderBy("file_id", "ord").collect()
    for k, file in ((0, 5), (3, 6)):
        own = good[k : k + 3]
        assert [(r["file_id"], r["bp_obs_time"], r["bp_flux"], r["bp_mag"], r["rp_obs_time"], r["variability_flag_bp_reject"]) for r in own] == [(file, 1.5, 100.0, 15.0, 1.6, False), (file, 2.5, 90.0, None, 2.6, False), (file, 3.5, 80.0, 15.2, None, True)]
        assert own[0]["g_transit_mag"] is None and own[2]["bp_flux_error"] is None
    bad = {r["path"].rsplit("_", 1)[1]: r["error"] for r in ecsv.bad_files(files).collect()}
    assert len(good) == 6 and set(bad) == {f"{i}.ecsv" for i in range(7, 13)} and bad["7.ecsv"] == "no column bp_obs_time" and "length" in bad["11.ecsv"] and "differs" in bad["12.ecsv"]
    got = epochs.load(spark, "gaia", spark.createDataFrame([(i,) for i in range(5, 13)], "SOURCE_ID long"), str(tmp_path)).collect()
    assert sorted((r["source_id"], r["band"], r["t"]) for r in got) == [(5, "bp", 1.5), (6, "bp", 1.5)]


def test_tables_by_name(spark, tmp_path):
    head = "# %ECSV 1.0\n# ---\n# delimiter: ','\n# datatype:\n# - {name: sep, datatype: float64}\n"
    texts = {"a.ecsv": head + 'more,sep,ztf_id,ID\nx,0.05,7,1\nx,"",-1,2\n', "b.ecsv": '# c\nmore sep ztf_id ID\n"x y" 0.05 7 1\nx "" -1 2\n', "c.csv": "more,sep,ztf_id,ID\n\"x,y\",0.05,7,1\nx,,-1,2\n", "d.dat": '# c\nmore   sep ztf_id  ID\n"x y"  0.05  7   1\n x    nan -1  2\n'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        got = ecsv.read_table(spark, str(tmp_path / name), "ID long, ztf_id long, sep double").orderBy("ID").collect()
        assert [tuple(r) for r in got[:1]] == [(1, 7, 0.05)] and got[1]["ztf_id"] == -1 and (got[1]["sep"] is None or np.isnan(got[1]["sep"])), name
        with pytest.raises(ValueError, match="no column absent"):
            ecsv.read_table(spark, str(tmp_path / name), "ID long, absent int")
    with pytest.raises(ValueError):
        ecsv.read_table(spark, "x.txt", "a int")


def test_load_surveys(spark, tmp_path):
    head = " ".join(x.split(" ")[0] for x in epochs.GAIA_WIDE.split(", ")[:15])
    (tmp_path / "gaia").mkdir()
    (tmp_path / "gaia" / "epphot_DR3_77.ecsv").write_text(f"# comment\n{head}\n1.0 15.0 100.0 1.0 1.1 15.0 100.0 1.0 1.2 15.0 100.0 1.0 false true false\n2.0 15.0 100.0 1.0 2.1 15.0 90.0 1.0 2.2 15.0 80.0 1.0 false false false\n")
    (tmp_path / "gaia" / "epphot_DR3_78.ecsv").write_text(f"{head}\n1.0 15.0 100.0 1.0 1.1 15.0 100.0 1.0 1.2 15.0 100.0 1.0 false true false\n")
    got = epochs.load(spark, "gaia", spark.createDataFrame([(77,)], "SOURCE_ID long"), str(tmp_path / "gaia")).collect()
    assert sorted((r["source_id"], r["band"]) for r in got) == [(77, "bp"), (77, "g"), (77, "g"), (77, "rp"), (77, "rp")]
    (tmp_path / "ztf" / "epoch_phot").mkdir(parents=True)
    (tmp_path / "ztf" / "other").mkdir()
    body = "mag mjd oid catflags magerr filtercode\n15.0 {0} 3 0 0.1 zg\n15.0 2.0 3 2 0.1 zg\n15.0 3.0 3 0 0.1 zx\n"
    for p, t in (("ztf_5.ecsv", 1.0), ("epoch_phot/ztf_5.ecsv", 4.0), ("ztf_6.ecsv", 5.0), ("epoch_phot/ztf_7.ecsv", 6.0), ("other/ztf_8.ecsv", 7.0)):
        (tmp_path / "ztf" / p).write_text(body.format(t))
    (tmp_path / "ztf" / "ztf_10.ecsv").write_text("bad\n1 2\n")
    (tmp_path / "ztf" / "epoch_phot" / "ztf_10.ecsv").write_text(body.format(8.0))
    match = spark.createDataFrame([(9, 5, 0.05), (9, 5, 0.06), (9, 6, 0.5), (9, 7, 0.01), (9, 8, 0.01), (9, 10, 0.01)], "ID long, ztf_id long, sep double")
    got = epochs.load(spark, "ztf", spark.createDataFrame([(9,)], "ID long"), str(tmp_path / "ztf"), match).collect()
    assert sorted((r["source_id"], r["t"], r["mag"]) for r in got) == [(9, 1.0, 15.0), (9, 6.0, 15.0)]
    with pytest.raises(ValueError):
        epochs.load(spark, "other", match, "x")
