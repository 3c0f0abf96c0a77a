"""Jobs that took too long on larger tables: their results against the definition, and what they cost."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest

from lumenfold.config import EngineConfig
from lumenfold.operators import decompose, harmonics, spectrum


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_peak_to_peak(spark):
    """A template stays one row: its values on the grid are no rows of the plan."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=m).tolist(), rng.normal(size=m).tolist()) for i, m in enumerate([1, 2, 3] * 100)]
    rows += [(7, [1.0, 0.5], [0.0, 2.0]), (7, None, [1.0]), (None, [1.0], [1.0]), (900, [None], [1.0]), (901, [], []), (902, [1.0, 2.0], [1.0])]
    df = harmonics.peak_to_peak(spark.createDataFrame(rows, "name long, a array<double>, b array<double>"))
    assert "explode" not in plan(df).lower()
    got = {r["name"]: r["ptp"] for r in df.collect()}
    phi = np.arange(1001) / 1000
    value = lambda a, b: sum(x * np.cos(2 * np.pi * j * phi) + y * np.sin(2 * np.pi * j * phi) for j, (x, y) in enumerate(zip(a, b, strict=True), 1)) + 0 * phi
    fine = [r for r in rows if r[1] is not None and len(r[1]) == len(r[2]) and None not in r[1]]
    want = {n: np.diff(np.percentile(np.concatenate([value(*r[1:]) for r in fine if r[0] == n]), [1, 99]))[0] for n in {r[0] for r in fine}}
    assert len(got) == 304 and got.pop(900) is None and got.pop(902) is None and got == pytest.approx(want, abs=1e-12)


def test_low_peaks_are_settled_together(monkeypatch):
    """The highest peak by the low end, with a small prominence, under or beside a higher end: no column is looked at alone."""
    rng = np.random.default_rng(4)
    p = np.abs(rng.normal(size=(284, 300))) * 0.1 + np.exp(-np.arange(284) / 6)[:, None] * rng.uniform(0, 3, 300)
    want = [spectrum.significant(x, 1.0, 1)[0] for x in p.T]
    highest = np.array([p[1:-1, i].argmax() + 1 for i in range(300)])
    assert sum(len(w) > 0 and w[0] != h for w, h in zip(want, highest, strict=True)) > 30  # the highest one is not it
    monkeypatch.setattr(spectrum, "significant", None)
    assert spectrum.highest(p, 1.0)[0].tolist() == [w[0] if len(w) else -1 for w in want]


def test_even_frequencies():
    """Powers at even steps by products are those at the same frequencies one by one."""
    rng = np.random.default_rng(5)
    curve = spectrum.Curve(np.sort(rng.uniform(0, 400, 60)), rng.normal(size=60), rng.random(60) + 0.5, rng.integers(0, 3, 60), 3)
    f, values, sums = np.linspace(rng.uniform(0.1, 2, 4), rng.uniform(2, 5, 4), 41).T, rng.normal(size=(60, 4)), [rng.random((3, 4)), 50 + rng.random((3, 4))]
    assert curve.own_power(f, values, sums, even=True) == pytest.approx(curve.own_power(f, values, sums), abs=1e-10)


@pytest.mark.parametrize("mode", ["gaia", "ogle"])
def test_free_periods_in_tasks(spark, monkeypatch, mode):
    """All rounds in the task that has a source's points give the periods of the rounds over tables, with bands that are thin, absent or not activated."""
    rng, cfg, rows = np.random.default_rng(6), EngineConfig(mode=mode, m_max=4, pmin=0.5, period_fit=True), []
    for s in range(6):
        t = np.sort(rng.uniform(0, 30, 50))
        band = [cfg.bands[i % len(cfg.bands)] if s != 1 else cfg.activated[0] for i in range(50)]
        band[0] = cfg.activated[-1]
        y = 15 + 0.5 * np.cos(2 * np.pi * t / (0.8 + 0.3 * s)) + 0.1 * np.cos(4 * np.pi * t / (0.8 + 0.3 * s) + 1) + rng.normal(0, 0.01, 50)
        rows += [(s, band[i], float(t[i]), float(y[i]), 0.01, i) for i in range(50)]
    points = decompose.clean_points(spark.createDataFrame(rows, "source_id long, band string, t double, mag double, emag double, ord long"), cfg)
    found = spark.createDataFrame([(s, c, (0.8 + 0.3 * s) * (1.002 - 0.003 * c), None, 3 + c) for s in range(7) for c in range(2)], "source_id long, cand int, P double, Z double, m int")
    given = {(r["source_id"], r["cand"]): r["P"] for r in found.collect()}
    whole = {(r["source_id"], r["cand"]): r for r in decompose.free_periods(points, found, cfg, rounds=4, most_points=0).collect()}
    monkeypatch.setattr(decompose, "fits", None)
    got = {(r["source_id"], r["cand"]): r for r in decompose.free_periods(points, found, cfg, rounds=4).collect()}
    assert len(got) == 12 and set(got) == set(whole) and all(got[k]["m"] == 3 + k[1] and got[k]["Z"] is None for k in got)
    assert {k: r["P"] for k, r in got.items()} == pytest.approx({k: r["P"] for k, r in whole.items()}, rel=1e-9)
    assert sum(abs(r["P"] / given[k] - 1) > 1e-4 for k, r in got.items()) > 9
