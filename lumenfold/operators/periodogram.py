"""Frequency grids, multi-band periodograms, sampling windows, aliases and period clusters.

The cost is points x frequencies. Points meet once, as one row of arrays for each source
(``curves``); grids, powers, peaks and their refinement then come from NumPy kernels over
that row in blocks of bounded size, and what leaves a task is an array for each source, or
its few peaks, never a row for each frequency. A source of more than ``POINTS`` points has several
rows, whose trigonometric sums are added up by blocks of frequencies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.operators import spectrum as kernels
from lumenfold.sources.tables import saved, spread

#: most points of a source in one row
POINTS = 200_000
REFINE = 41


def grids(epochs: DataFrame, n0: int = 2, pmin: float = 0.2, pmax: float = 300.0) -> DataFrame:
    """``source_id, fmin, df, nf``: a step of 1/(n0 T), from 1/pmax to just over 1/pmin."""
    return _extent(epochs, n0, pmin, pmax).select("source_id", "fmin", "df", "nf")


def _extent(epochs: DataFrame, n0: int, pmin: float, pmax: float) -> DataFrame:
    g = epochs.groupBy("source_id").agg((F.max("t") - F.min("t")).alias("span"), F.min("t").alias("t0"), F.avg("mag").alias("level"), F.count("*").alias("points"))
    g = g.where("span > 0").withColumn("df", 1 / (n0 * F.col("span"))).withColumn("fmin", F.lit(1 / pmax))
    return g.withColumn("nf", F.ceil((1 / pmin + F.col("df") - 1 / pmax) / F.col("df")))


def curves(epochs: DataFrame, n0: int = 2, pmin: float = 0.2, pmax: float = 300.0, points: int = POINTS) -> DataFrame:
    """A row for each source, several for one of more than ``points``: its grid, and its points as arrays sorted by band and time.

    ``source_id, part, parts, t0, fmin, df, nf, band array<string>, t, y, e array<double>``; times from
    the source's first, ``t0``, values from its mean, so that sums keep their digits. Sources of one time have none. A
    source's parts are dealt by hash, so none needs an order over all its points.
    """
    grid = _extent(epochs, n0, pmin, pmax).withColumn("parts", F.ceil(F.col("points") / points))
    rows = spread(epochs, "source_id").join(grid, "source_id").withColumn("part", F.pmod(F.xxhash64("t", "mag", "emag", "band"), F.col("parts")))
    point = F.struct("band", (F.col("t") - F.col("t0")).alias("t"), (F.col("mag") - F.col("level")).alias("y"), F.col("emag").alias("e"))
    key = ["source_id", "part", "parts", "t0", "fmin", "df", "nf"]
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(point)).alias("x"))
    return lists.select(*key, *(F.col(f"x.{c}").alias(c) for c in ("band", "t", "y", "e")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, kernels.Curve]]:
    """Each row's scalars, the names of the bands in order, and its curve, weighted by the errors."""
    for batch in batches:
        scalars = [c for c in batch.schema.names if c not in ("band", "t", "y", "e")]
        values = {c: batch.column(c).to_pylist() for c in scalars}
        edges = batch.column("t").offsets.to_numpy()
        band = batch.column("band").flatten().dictionary_encode()
        names = sorted(band.dictionary.to_pylist())
        place = np.array([names.index(b) for b in band.dictionary.to_pylist()], int)[band.indices.to_numpy()]
        t, y, e = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in "tye")
        first = edges[0] if len(edges) else 0
        for i, (a, b) in enumerate(zip((edges[:-1] - first).tolist(), (edges[1:] - first).tolist(), strict=True)):
            row = {c: values[c][i] for c in scalars}
            yield row | {"bands": names}, kernels.Curve(t[a:b], y[a:b], 1 / e[a:b] ** 2, place[a:b], len(names))


def grid_power(row: dict, curve: kernels.Curve, least: int) -> np.ndarray:
    return np.concatenate([kernels.power(curve.totals, first, second, least)[:, 0] for _, first, second in curve.blocks(row["fmin"], row["df"], row["nf"])])


def _window(row: dict, curve: kernels.Curve) -> np.ndarray:
    curve.w = np.ones_like(curve.w)
    p = np.concatenate([(np.abs(first[..., 0]) ** 2).sum(0) for _, first, _ in curve.blocks(row["fmin"], row["df"], row["nf"])])
    return p / p.max()


def over_curves(rows: DataFrame, schema: str, each: Callable[[dict, kernels.Curve], Iterator[tuple]]) -> DataFrame:
    """``each`` gives result tuples behind the source's id for a row and its curve."""
    kind = dict(rows.dtypes)["source_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = [(row["source_id"], *x) for row, curve in _rows(iter([batch])) for x in each(row, curve)]
            columns = list(zip(*out, strict=True)) if out else [()] * (1 + len(names))
            yield pa.RecordBatch.from_pydict({"source_id": pa.array(columns[0], batch.schema.field("source_id").type)} | dict(zip(names, map(list, columns[1:]), strict=True)), schema=pa.schema([batch.schema.field("source_id"), *_fields(schema)]))

    return rows.mapInArrow(run, f"source_id {kind}, {schema}")


def _fields(schema: str) -> list[pa.Field]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "string": pa.string(), "binary": pa.binary()}
    return [pa.field(*(x.split()[0], kinds[x.split()[1]])) for x in schema.split(", ")]


def _added(parts: DataFrame, least: int) -> DataFrame:
    """Powers ``source_id, block, f array<double>, power, window`` of a source's parts: their sums by block of frequencies are added up.

    A row of ``parts`` has ``source_id, block, f, bands`` and the sums by band, all as bytes of doubles.
    """
    kind = dict(parts.dtypes)["source_id"]

    def add(table: pa.Table) -> pa.Table:
        f = np.frombuffer(table.column("f")[0].as_py())
        sums: dict[str, np.ndarray] = {}
        for names, raw in zip(table.column("bands").to_pylist(), table.column("sums").to_pylist(), strict=True):
            own = np.frombuffer(raw).reshape(len(names.split(",")), -1) if names else np.zeros((0, 4 + 8 * len(f)))
            for b, x in zip(names.split(","), own, strict=False):
                sums[b] = sums.get(b, 0) + x
        x = np.array([sums[b] for b in sorted(sums)])
        totals, z = x[:, :4], x[:, 4:].view(complex).reshape(len(x), 4, len(f))
        p = kernels.power(totals, np.stack([z[:, 0], z[:, 1]], axis=2), z[:, 2], least)[:, 0]
        window = (np.abs(z[:, 3]) ** 2).sum(0)
        arrays = [table.column("source_id")[:1], table.column("block")[:1], *(pa.array([v.tolist()]) for v in (f, p, window))]
        return pa.table(arrays, names=["source_id", "block", "f", "power", "window"])

    return parts.groupBy("source_id", "block").applyInArrow(add, f"source_id {kind}, block long, f array<double>, power array<double>, window array<double>")


def _part_sums(block: int, f: np.ndarray, row: dict, curve: kernels.Curve, first: np.ndarray, second: np.ndarray) -> tuple:
    plain = np.zeros_like(second)
    weights, curve.w = curve.w, np.ones_like(curve.w)
    for k in range(0, len(f), kernels.BLOCK):
        plain[:, k : k + kernels.BLOCK] = curve.at(f[k : k + kernels.BLOCK])[0][..., 0]
    curve.w = weights
    sums = [np.concatenate([t, *(np.ascontiguousarray(v).view(float) for v in (a[:, 0], a[:, 1], b, w))]) for t, a, b, w in zip(curve.totals, first, second, plain, strict=True)]
    return block, f.tobytes(), ",".join(row["bands"]), np.concatenate(sums).tobytes() if sums else b""


_PARTS = "block long, f binary, bands string, sums binary"


def spectra(rows: DataFrame, window: bool = False, least: int = 4) -> DataFrame:
    """``source_id, fmin, df, power array<double>`` over the grid of each source of ``curves``.

    Generalised Lomb-Scargle power with a floating mean by band, bands of ``least`` points or
    more weighted by their scatter; or, with ``window``, the power of the sampling window
    summed over bands, over its maximum. ``rows`` should be ``saved``: they are read again where a source has
    several, and only for these there is an exchange.
    """
    whole = lambda row, curve: [(row["fmin"], row["df"], (_window(row, curve) if window else grid_power(row, curve, least)).tolist())]
    light = over_curves(rows.where("parts = 1"), "fmin double, df double, power array<double>", whole)

    def partial(row: dict, curve: kernels.Curve) -> Iterator[tuple]:
        for k, first, second in curve.blocks(row["fmin"], row["df"], row["nf"]):
            yield _part_sums(k, row["fmin"] + row["df"] * np.arange(k, k + second.shape[1]), row, curve, first, second)

    many = rows.where("parts > 1")
    if not many.limit(1).count():
        return light
    added = _added(over_curves(many.repartition("source_id", "part"), _PARTS, partial), least)
    arrays = added.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("block", "window" if window else "power"))).alias("x"))
    values = F.flatten(F.transform("x", lambda b: b["window" if window else "power"]))
    if window:
        values = F.transform(values, lambda v: v / F.array_max(values))
    heavy = arrays.join(many.select("source_id", "fmin", "df").distinct(), "source_id").select("source_id", "fmin", "df", values.alias("power"))
    return light.unionByName(heavy)


def spread_out(spectrum: DataFrame, name: str = "power") -> DataFrame:
    """A row for each frequency of an array: ``source_id, k, f, {name}``."""
    x = spectrum.select("source_id", "fmin", "df", F.posexplode("power").alias("k", name))
    return x.select("source_id", F.col("k").cast("long").alias("k"), (F.col("fmin") + F.col("k") * F.col("df")).alias("f"), name)


def gls(epochs: DataFrame, n0: int = 2, pmin: float = 0.2, pmax: float = 300.0, least: int = 4) -> DataFrame:
    """The power of ``spectra`` as ``source_id, k, f, power``."""
    return spread_out(spectra(saved(curves(epochs, n0, pmin, pmax)), least=least))


def window_power(epochs: DataFrame, n0: int = 2, pmin: float = 0.2, pmax: float = 300.0) -> DataFrame:
    """The sampling window's power of ``spectra`` as ``source_id, k, f, wpower``."""
    return spread_out(spectra(saved(curves(epochs, n0, pmin, pmax)), window=True), "wpower")


def powers_at(rows: DataFrame, wanted: DataFrame, least: int = 4) -> DataFrame:
    """Power at a few frequencies ``source_id, fs array<double>`` of each source of ``curves``, several rows of one included."""
    sums = lambda row, curve: [_part_sums(0, np.array(row["fs"]), row, curve, *curve.at(np.array(row["fs"])))]
    return _added(over_curves(rows.join(wanted, "source_id"), _PARTS, sums), least).select("source_id", F.col("f").alias("fs"), "power")


def _over_arrays(spectrum: DataFrame, schema: str, each: Callable[[float, float, np.ndarray], Iterator[tuple]]) -> DataFrame:
    kind = dict(spectrum.dtypes)["source_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _fields(schema)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("source_id", "fmin", "df")), batch.column("power"), strict=True)
            out = [(source, *x) for source, f0, df, p in rows for x in each(f0, df, np.nan_to_num(p.values.to_numpy(zero_copy_only=False)))]
            columns = list(zip(*out, strict=True)) if out else [()] * (1 + len(fields))
            field = batch.schema.field("source_id")
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, [field, *fields], strict=True)], schema=pa.schema([field, *fields]))

    return spectrum.select("source_id", "fmin", "df", "power").mapInArrow(run, f"source_id {kind}, {schema}")


def top_peaks(spectrum: DataFrame, count: int = 5) -> DataFrame:
    """The highest strict local maxima of each array: ``source_id, f, period, power, rank`` (from 1); larger f first on ties."""

    def each(f0: float, df: float, p: np.ndarray) -> Iterator[tuple]:
        at = np.flatnonzero((p[1:-1] > p[:-2]) & (p[1:-1] > p[2:])) + 1
        for rank, i in enumerate(np.lexsort((at, p[at]))[::-1][:count]):
            f = f0 + df * int(at[i])
            yield f, 1 / f, float(p[at[i]]), rank + 1

    return _over_arrays(spectrum, "f double, period double, power double, rank int", each)


def pick_peaks(spectrum: DataFrame, how: str, count: int, snr: float = 5.0, n0: int = 2) -> DataFrame:
    """Peaks of each array: ``source_id, rank, f, height, prominence, sigma``.

    ``how`` is ``power``: at least ``snr`` standard deviations high and of at least the
    median prominence of such, by height; or ``window``: at least the 95th percentile
    high, of a prominence of 5 median absolute deviations, ``max(10, 5 n0)`` points
    apart, by prominence.
    """

    def each(f0: float, df: float, p: np.ndarray) -> Iterator[tuple]:
        at, rise, sigma = kernels.significant(p, snr, count) if how == "power" else (*kernels.prominent(p, max(10, 5 * n0), count), float(p.std()))
        for rank, (i, r) in enumerate(zip(at.tolist(), rise.tolist(), strict=True)):
            yield rank, f0 + df * i, float(p[i]), r, sigma

    return _over_arrays(spectrum, "rank int, f double, height double, prominence double, sigma double", each)


def peak_prominences(spectrum: DataFrame) -> DataFrame:
    """Every local maximum of each array with its prominence: ``source_id, k, height, prominence``."""

    def each(f0: float, df: float, p: np.ndarray) -> Iterator[tuple]:
        at = kernels.local_maxima(p)
        yield from zip(at.tolist(), p[at].tolist(), kernels.prominences(p, at).tolist(), strict=True)

    return _over_arrays(spectrum, "k long, height double, prominence double", each)


def local_background(spectrum: DataFrame, half: int = 100, floor: float = 1e-6) -> DataFrame:
    """Running median ``bg`` and scatter ``sig`` over ``half`` neighbours to each side: ``source_id, k, bg, sig``.

    The scatter is 1.4826 times the running median of the deviations, each from the
    background at its own place, at least ``floor``; beyond the ends the end values repeat.
    """

    def each(f0: float, df: float, p: np.ndarray) -> Iterator[tuple]:
        yield from ((i, *x) for i, x in enumerate(zip(*(v.tolist() for v in kernels.background(p, half, floor)), strict=True)))

    return _over_arrays(spectrum, "k long, bg double, sig double", each)


def near(f: np.ndarray, df: float, pmin: float, pmax: float) -> np.ndarray:
    """``REFINE`` frequencies a step to each side of each ``f``, inside the range."""
    low, high = np.maximum(f - df, 1 / pmax), np.minimum(f + df, 1 / pmin)
    return low[:, None] + (high - low)[:, None] / (REFINE - 1) * np.arange(REFINE)


def find_periods(row: dict, power_at: Callable[[np.ndarray], np.ndarray], p: np.ndarray, cfg, snr: float, peaks: int, harmonics: int) -> list[tuple[int, float, float]]:
    """Candidates (number, period, power) of one curve with grid power ``p``: its peaks, refined, with harmonics, above 3 deviations."""
    at, _, sigma = kernels.significant(np.nan_to_num(p), snr, peaks)
    if not len(at):
        return []
    f = row["fmin"] + row["df"] * at
    rough = row["df"] / f > cfg.period_tol
    if rough.any():
        close = near(f, row["df"], cfg.pmin, cfg.pmax)
        f = np.where(rough, kernels.refined(close, power_at(close.ravel()).reshape(close.shape)), f)
    periods = [q for x in f.tolist() for q in sorted(kernels.candidates(x, harmonics, cfg.pmin, cfg.pmax), key=lambda q: abs(math.log(q)))]
    z = power_at(1 / np.array(periods))
    return [(i, q, float(v)) for i, (q, v) in enumerate(zip(periods, z, strict=True)) if v > 3 * sigma]


def search_periods(epochs: DataFrame, cfg, points: int = POINTS) -> DataFrame:
    """Candidate periods ``source_id, cand, P, Z``: the highest peaks, refined, with their harmonics, if above 3 standard deviations.

    A peak is refined on ``REFINE`` frequencies a step to each side and by the parabola
    through the best three, unless the grid is fine enough already. One kernel does it
    for a source in one row; the sums of a source in several rows are added up for each step.
    """
    rows = saved(curves(epochs, cfg.n0, cfg.pmin, cfg.pmax, points))

    def each(row: dict, curve: kernels.Curve) -> list[tuple]:
        at = lambda f: kernels.power(curve.totals, *curve.at(f))[:, 0]
        return find_periods(row, at, grid_power(row, curve, 4), cfg, cfg.snr, cfg.peaks, cfg.harmonics)

    light = over_curves(rows.where("parts = 1"), "cand int, P double, Z double", each)
    many = rows.where("parts > 1")
    if not many.limit(1).count():
        return light
    peaks = saved(pick_peaks(spectra(many), "power", cfg.peaks, cfg.snr).join(many.select("source_id", "df").distinct(), "source_id"))
    low, high = F.greatest(F.col("f") - F.col("df"), F.lit(1 / cfg.pmax)), F.least(F.col("f") + F.col("df"), F.lit(1 / cfg.pmin))
    near = F.transform(F.sequence(F.lit(0), F.lit(REFINE - 1)), lambda i: low + i * (high - low) / (REFINE - 1))
    asked = peaks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rank", near.alias("near")))).alias("x")).select("source_id", F.flatten(F.transform("x", lambda r: r["near"])).alias("fs"))
    at = powers_at(many, asked).select("source_id", F.posexplode(F.arrays_zip("fs", "power")).alias("i", "x"))
    best = F.max_by(F.struct("i", "x"), F.struct("x.power", "x.fs"))
    shaped = at.groupBy("source_id", F.floor(F.col("i") / REFINE).cast("int").alias("rank")).agg(best.alias("b"), F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    of = lambda k, c: F.try_element_at("m", F.col("b.i") + k)[c]
    same = lambda k: F.floor((F.col("b.i") + k) / REFINE) == F.col("rank")
    shift = F.when(same(-1) & same(1), 0.5 * F.try_divide(of(-1, "power") - of(1, "power"), of(-1, "power") - 2 * of(0, "power") + of(1, "power")) * (of(1, "fs") - of(0, "fs")))
    best = shaped.select("source_id", "rank", (F.col("b.x.fs") + F.coalesce(shift, F.lit(0.0))).alias("best"))
    found = peaks.join(best, ["source_id", "rank"]).select("source_id", "rank", "sigma", (1 / F.when(F.col("df") / F.col("f") > cfg.period_tol, F.col("best")).otherwise(F.col("f"))).alias("period"))
    every = harmonic_periods(found, cfg.harmonics, cfg.pmin, cfg.pmax)
    every = saved(every.withColumn("cand", F.row_number().over(W.partitionBy("source_id").orderBy("rank", F.abs(F.ln(F.col("period"))))) - 1))
    own = every.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand", "period"))), lambda r: 1 / r["period"]).alias("fs"))
    scored = powers_at(many, own).select("source_id", F.posexplode("power").alias("cand", "power"))
    heavy = every.join(scored, ["source_id", "cand"]).where("power > 3 * sigma").select("source_id", F.col("cand").cast("int").alias("cand"), F.col("period").alias("P"), F.col("power").alias("Z"))
    return light.unionByName(heavy)


def search_windows(epochs: DataFrame, cfg, peaks: int = 5, aliases: int = 10, snr: float = 3.0, harmonics: int = 2, tol: float = 0.1, width: float = 1.0, n0: int = 5) -> DataFrame:
    """Period windows of each source from its best peaks and the sampling's aliases of them.

    ``source_id, P0_LS, Zmax, alias_freqs array<double>, windows array<struct<lo, hi>>`` (log10 of days). A
    source without peaks has no row; one without aliases has no windows.
    """
    rows = saved(curves(epochs, n0, cfg.pmin, cfg.pmax))
    coarse = saved(pick_peaks(spectra(rows), "power", peaks, snr))
    window = saved(pick_peaks(spectra(rows, window=True), "window", aliases, n0=n0))
    return windows_of(coarse, window, cfg, harmonics, tol, width)


def windows_of(coarse: DataFrame, window: DataFrame, cfg, harmonics: int = 2, tol: float = 0.1, width: float = 1.0) -> DataFrame:
    """The windows of ``search_windows`` from each source's peaks ``source_id, f, height`` and alias frequencies ``source_id, rank, f``."""
    pairs = coarse.select("source_id", F.col("f").alias("own")).join(window.select("source_id", F.col("f").alias("fa")), "source_id")
    signs = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(s).alias("sign")) for n in range(1, harmonics + 1) for s in (1, -1))))
    alias = pairs.withColumn("x", signs).select("source_id", F.try_divide(F.lit(1.0), F.abs(F.col("x.n") * F.col("own") + F.col("x.sign") * F.col("fa"))).alias("period"))
    clusters = cluster_periods(alias.where(F.col("period").between(cfg.pmin, cfg.pmax)), tol, max_width=width)
    clusters = clusters.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("windows"))
    top = coarse.groupBy("source_id").agg(F.max_by(F.struct((1 / F.col("f")).alias("P0_LS"), F.col("height").alias("Zmax")), F.struct("height", "f")).alias("x")).select("source_id", "x.*")
    listed = window.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "f"))), lambda r: r["f"]).alias("alias_freqs"))
    out = top.join(listed, "source_id", "left").join(clusters, "source_id", "left")
    return out.select("source_id", "P0_LS", "Zmax", F.coalesce("alias_freqs", F.array().cast("array<double>")).alias("alias_freqs"), F.coalesce("windows", F.array().cast("array<struct<lo:double,hi:double>>")).alias("windows"))


def harmonic_periods(periods: DataFrame, harmonics: int, pmin: float, pmax: float) -> DataFrame:
    """Each period with its multiples and fractions inside [pmin, pmax]."""
    own = F.array("period")
    if harmonics >= 2:
        n = F.sequence(F.lit(2), F.lit(harmonics))
        more = F.concat(F.filter(F.transform(n, lambda k: F.col("period") * k), lambda p: p <= pmax), F.filter(F.transform(n, lambda k: F.col("period") / k), lambda p: p >= pmin))
        own = F.concat(own, more)
    return periods.withColumn("period", F.explode(own))


def aliased_periods(periods: DataFrame, alias: tuple[float, ...], n: int = 1, m: int = 1) -> DataFrame:
    """``1 / |n / P +- m fa|`` for each period, alias frequency and sign; a zero frequency has no period."""
    pairs = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("fa"), F.lit(s).alias("sign")) for a in alias for s in (1, -1))))
    rows = periods.withColumn("x", pairs).select("*", "x.fa", "x.sign").drop("x")
    return rows.withColumn("alias", F.try_divide(F.lit(1.0), F.abs(n / F.col("period") + F.col("sign") * m * F.col("fa"))))


def alias_mask(f: Column, f0: Column, fa: float, count: int, tol: float) -> Column:
    return F.exists(F.sequence(F.lit(1), F.lit(count)), lambda n: (F.abs(f - (f0 + n * fa)) < tol) | (F.abs(f - (f0 - n * fa)) < tol))


def cluster_periods(periods: DataFrame, tol: float = 0.05, min_gap: float = 0.0, max_width: float | None = None) -> DataFrame:
    """Merge intervals ``log10 P +- tol`` that touch, up to ``max_width``: ``source_id, lo, hi, n``.

    Without a width it is gaps and islands; with one, a fold over the sorted periods of a source.
    """
    x = periods.where("period > 0 and not isnan(period) and period < double('inf')").select("source_id", F.log10("period").alias("x"))
    if max_width is None:
        w = W.partitionBy("source_id").orderBy("x")
        x = x.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(w) > 2 * tol + min_gap).cast("int"), F.lit(1)))
        x = x.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return x.groupBy("source_id", "island").agg((F.min("x") - tol).alias("lo"), (F.max("x") + tol).alias("hi"), F.count("*").alias("n")).drop("island")
    start = F.array().cast("array<struct<lo:double,hi:double,n:bigint>>")

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (v - tol <= F.try_element_at(acc, F.lit(-1))["hi"] + min_gap) & (v + tol - F.try_element_at(acc, F.lit(-1))["lo"] <= max_width)
        merged = F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(last["lo"].alias("lo"), (v + tol).alias("hi"), (last["n"] + 1).alias("n"))))
        return F.when(joins, merged).otherwise(F.concat(acc, F.array(F.struct((v - tol).alias("lo"), (v + tol).alias("hi"), F.lit(1).cast("long").alias("n")))))

    return x.groupBy("source_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("source_id", F.inline(F.aggregate("xs", start, step)))
