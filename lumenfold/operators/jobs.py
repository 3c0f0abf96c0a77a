"""Template-fit planning, running and roll-up; quality tables; injection and recovery."""

from __future__ import annotations

import os
import subprocess
import tempfile
import time
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.config import EngineConfig
from lumenfold.operators import harmonics, periodogram, phase, spectrum, stats
from lumenfold.sources.tables import saved, spread


def period_windows(periods: DataFrame, pmin: float, pmax: float, tol: float = 0.1) -> DataFrame:
    """Padded log windows of ``source_id, period, best`` inside [pmin, pmax]; p0flag is 0 next to the best period."""
    lo, hi = F.greatest(F.log10("period") - tol, F.log10(F.lit(pmin))), F.least(F.log10("period") + tol, F.log10(F.lit(pmax)))
    rows = periods.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi").withColumn("P0", F.pow(F.lit(10.0), (F.col("lo") + F.col("hi")) / 2))
    near = F.abs(F.log10("P0") - F.log10("best")) < min(0.05, tol)
    return rows.select("source_id", "P0", F.pow(F.lit(10.0), F.col("lo")).alias("pmin"), F.pow(F.lit(10.0), F.col("hi")).alias("pmax"), F.when(near, 0).otherwise(1).alias("p0flag"))


def plan_jobs(windows: DataFrame, pairs: tuple[tuple[str, str], ...] = (("g", "bp"), ("g", "rp"))) -> DataFrame:
    """A job for each window (``window_idx``) and band pair; ids are source, pair and two digits."""
    pair = F.explode(F.array(*(F.lit("".join(p)) for p in pairs)))
    rows = windows.withColumn("bandpair", pair)
    return rows.withColumn("job_id", F.format_string("%s_%s_%02d", F.col("source_id").cast("string"), "bandpair", F.col("window_idx").cast("int")))


def build_plan(epochs: DataFrame, cfg: EngineConfig, bounds: tuple[float, float] | None = None, pairs: tuple[tuple[str, str], ...] = (("g", "bp"), ("g", "rp")), amplitude: tuple[float, float] = (0.05, 3.0), templates: tuple[int, int] = (1, 25), tol: float = 0.1, **search) -> tuple[DataFrame, DataFrame]:
    """The template-fit jobs of every source, and a row of metadata for each.

    A source has the whole period range as its first window, then those of
    ``periodogram.search_windows`` or, if given, the one of ``bounds``. Jobs: ``source_id,
    job_id, window_idx, bandpair, bands, P0, p0flag, pmin, pmax, Amin, Amax, tmpl_start,
    tmpl_end``. Metadata: ``source_id, P0_LS, Zmax, alias_freqs, windows, n_jobs``. A source
    whose search finds nothing keeps the first window; with ``bounds`` p0flag is 1.
    """
    log = lambda x: float(np.log10(x))
    window = lambda lo, hi: F.struct(F.lit(log(lo)).alias("lo"), F.lit(log(hi)).alias("hi"))
    sources = epochs.select("source_id").distinct()
    if bounds is None:
        found = sources.join(periodogram.search_windows(epochs.where(F.col("band").isin(*cfg.activated)), cfg, tol=tol, **search), "source_id", "left")
    else:
        found = sources.select("source_id", F.lit(None).cast("double").alias("P0_LS"), F.lit(None).cast("double").alias("Zmax"), F.array().cast("array<double>").alias("alias_freqs"), F.array(window(*bounds)).alias("windows"))
    empty = F.array().cast("array<struct<lo:double,hi:double>>")
    found = saved(found.withColumn("windows", F.concat(F.array(window(cfg.pmin, cfg.pmax)), F.coalesce("windows", empty))))
    rows = found.select("source_id", "P0_LS", F.posexplode("windows").alias("window_idx", "x"))
    middle = (F.col("x.lo") + F.col("x.hi")) / 2
    low, high = F.greatest(F.col("x.lo") - tol, F.lit(log(cfg.pmin))), F.least(F.col("x.hi") + tol, F.lit(log(cfg.pmax)))
    near = F.coalesce(F.abs(middle - F.log10("P0_LS")) < min(0.05, tol), F.lit(False))
    power = lambda x: F.pow(F.lit(10.0), x)
    rows = rows.where(low <= high).select("source_id", "window_idx", power(middle).alias("P0"), F.when(near, 0).otherwise(1).alias("p0flag"), power(low).alias("pmin"), power(high).alias("pmax"))
    constants = {"Amin": amplitude[0], "Amax": amplitude[1], "tmpl_start": templates[0], "tmpl_end": templates[1]}
    number = F.create_map(*(x for i, b in enumerate(cfg.bands) for x in (F.lit(b), F.lit(i))))
    bands = F.create_map(*(x for p in pairs for x in (F.lit("".join(p)), F.array(*(number[b] for b in p)))))
    jobs = plan_jobs(rows, pairs).withColumns({k: F.lit(v) for k, v in constants.items()}).withColumn("bands", bands[F.col("bandpair")])
    meta = found.withColumn("kept", F.size(F.filter("windows", lambda w: F.greatest(w["lo"] - tol, F.lit(log(cfg.pmin))) <= F.least(w["hi"] + tol, F.lit(log(cfg.pmax))))))
    return jobs, meta.withColumn("n_jobs", F.col("kept") * len(pairs)).drop("kept")


def save_plan(jobs: DataFrame, meta: DataFrame, path: str) -> None:
    """Write a plan as two tables under ``path``."""
    jobs.write.mode("overwrite").parquet(f"{path}/jobs")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_plan(spark: SparkSession, path: str, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs and metadata of a saved plan, of all sources or of those in ``sources``; a source without a plan has no rows."""
    both = tuple(spark.read.parquet(f"{path}/{x}") for x in ("jobs", "meta"))
    return both if sources is None else tuple(select_plan(x, sources) for x in both)


def select_plan(plan: DataFrame, sources: DataFrame) -> DataFrame:
    return plan.join(sources, "source_id", "left_semi")


def write_inputs(job: dict, folder: str) -> None:
    """The fitter's input files of one job, in ``folder``; it takes two bands at most."""
    if len(job["bands"]) > 2:
        raise ValueError("the fitter takes at most two bands")
    # fixed formats of the fitter's files
    lines = [f"{' '.join(map(str, job['bands']))} # SELECTED PHOTOMETRIC BAND PREFIXS", f"{job['pmin']:.6f} {job['pmax']:.6f} # PERIOD RANGE", f"{job['Amin']:.6f} {job['Amax']:.6f} # AMPLITUDE RANGE", f"{job['tmpl_start']:d} {job['tmpl_end']:d} # TEMPLATE RANGE"]
    files = {"rrfit.param": lines, "fitlc_list": [str(job.get("fitlc_path", ""))], "lomb_scargle.txt": ["SOURCE_ID P_LS p0flag", f"{job['source_id']} {job['P0']:.10f} {job['p0flag']}"]}
    for name, content in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(content) + "\n")


def last_row(path: str) -> str | None:
    """The last row of a table of text under a header, as ``name=value`` pairs; None without a file or a row."""
    try:
        with open(path) as f:
            lines = [x.split() for x in f if x.strip() and not x.startswith("#")]
    except OSError:
        return None
    return " ".join(f"{k}={v}" for k, v in zip(lines[0], lines[-1], strict=False)) if len(lines) > 1 else None


def last_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each ``key`` by ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def run_jobs(jobs: DataFrame, command: list[str], timeout: int = 300, output: str | None = None) -> DataFrame:
    """Run an external fitter for each job (``{job_id}`` and such in its arguments); off unless called.

    Each job has a folder of its own; jobs with the columns of ``build_plan`` find their
    input files there. The result is the last row of the table ``output`` that the
    fitter leaves in it or, without a name, the last line that it prints. Return code -9
    for a time-out, -999 if it can't start.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for job in pdf.to_dict("records"):
                with tempfile.TemporaryDirectory() as folder:
                    text = None
                    try:
                        if "bands" in job:
                            write_inputs(job, folder)
                        done = subprocess.run([c.format(**job) for c in command], cwd=folder, capture_output=True, text=True, timeout=timeout)
                        code, err = done.returncode, done.stderr[:500]
                        text = last_row(os.path.join(folder, output)) if output else done.stdout.strip().split("\n")[-1]
                    except subprocess.TimeoutExpired:
                        code, err = -9, "timed out"
                    except (OSError, ValueError) as e:
                        code, err = -999, str(e)[:500]
                out.append((job["job_id"], job["source_id"], code, text or None, err))
            yield pd.DataFrame(out, columns=["job_id", "source_id", "returncode", "result", "stderr"])

    return jobs.mapInPandas(run, f"job_id string, source_id {dict(jobs.dtypes)['source_id']}, returncode int, result string, stderr string")


def _finished(spark: SparkSession, path: str) -> list[str]:
    """The waves under ``path`` that were written whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    waves = [x.getPath() for x in store.listStatus(folder) if x.isDirectory()]
    return [str(x) for x in waves if store.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]


_LOG = "job_id string, source_id string, window_idx int, bandpair string, P0 double, pmin double, pmax double, p0flag int, returncode int, result_ok boolean, result string, stderr string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of ``run_plan``, one row for each job that has run; a job that ran again has its last row."""
    waves = _finished(spark, path)
    if not waves:
        return spark.createDataFrame([], _LOG)
    rows = spark.read.schema(_LOG).parquet(*waves).withColumn("wave", F.regexp_extract(F.input_file_name(), "wave-([0-9]+)-", 1))
    return last_rows(rows, "job_id", "wave").drop("wave")


def run_plan(jobs: DataFrame, command: list[str], path: str, wave: int = 10_000, retry: bool = False, timeout: int = 300, output: str | None = None) -> DataFrame:
    """Run the jobs of a plan that the log under ``path`` doesn't have yet, about ``wave`` at a time, and return the log.

    A wave's results are a folder of their own that counts once it is whole, so after a killed driver or
    executor a rerun of the same call starts the unfinished jobs only, at most one wave of them a second time.
    ``retry`` also runs those again that failed. ``source_log`` rolls the log up.
    """
    spark = jobs.sparkSession
    log = read_log(spark, path)
    done = log.where("result_ok") if retry else log
    todo = saved(jobs.join(done.select("job_id").distinct(), "job_id", "left_anti"))
    waves = -(-todo.count() // wave)
    facts = [c for c in ("window_idx", "bandpair", "P0", "pmin", "pmax", "p0flag") if c in jobs.columns]
    for k in range(waves):
        part = todo.where(F.pmod(F.xxhash64("job_id"), F.lit(waves)) == k)
        ran = run_jobs(spread(part, "job_id"), command, timeout, output).withColumn("result_ok", F.col("result").isNotNull() & (F.col("returncode") == 0))
        rows = ran.join(part.select("job_id", *facts), "job_id")
        columns = (x.split() for x in _LOG.split(", "))
        whole = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns))
        whole.write.parquet(f"{path}/wave-{time.time_ns():020d}-{k}")
    return read_log(spark, path)


def source_log(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """``source_id, n_jobs_total, n_jobs_finished, n_jobs_success`` of a plan's sources, from the log so far."""
    return roll_up(jobs.select("source_id", "job_id").join(log.select("job_id", "returncode", "result"), "job_id", "left"))


def run_counts(results: DataFrame) -> DataFrame:
    """``status, n``: how many jobs are ok, failed, or not finished."""
    status = F.when(F.col("returncode").isNull(), "open").when((F.col("returncode") == 0) & F.col("result").isNotNull(), "ok").otherwise("failed")
    return results.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def write_summaries(results: DataFrame, path: str) -> None:
    """One table of the successful jobs' results, with a folder for each of 256 groups of sources."""
    good = results.where("returncode = 0 and result is not null").withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(256)).cast("int"))
    good.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def roll_up(results: DataFrame) -> DataFrame:
    """Jobs of each source: all, finished, and successful (code 0 and a result)."""
    return results.groupBy("source_id").agg(F.count("*").alias("n_jobs_total"), F.count_if(F.col("returncode").isNotNull()).alias("n_jobs_finished"), F.count_if((F.col("returncode") == 0) & F.col("result").isNotNull()).alias("n_jobs_success"))


def quality_table(epochs: DataFrame, fd: DataFrame, cfg: EngineConfig, n_grid: int = 50, statistic: str = "median", bands: tuple[str, ...] | None = None) -> DataFrame:
    """By source and band: N, coverage, gaps, residual grid, model grid and mask. Sources without a fit are left out.

    Points meet their source's fit in one join; gaps, bins and the row itself then share
    one partitioning by source and band.
    """
    how = {"mean": F.avg("residual"), "median": F.median("residual"), "rms": F.sqrt(F.avg(F.col("residual") * F.col("residual")))}
    if statistic not in how:
        raise ValueError(f"unknown statistic {statistic!r}")
    n, own = range(1, cfg.m_max + 1), bands or cfg.bands
    level = lambda k: F.create_map(*(x for b in cfg.bands for x in (F.lit(b), F.col(f"{k}_{b}"))))
    model = saved(fd).select(F.col("ID").alias("source_id"), "P", "E", level("m0").alias("m0s"), level("amp").alias("amps"), F.array(*(F.col(f"A{j}") for j in n)).alias("A"), F.array(*(F.col(f"Q{j}") for j in n)).alias("Q"))
    value = lambda phi: harmonics.model(phi, F.col("m0"), F.col("amp"), F.col("A"), F.col("Q"))
    rows = epochs.where(F.col("band").isin(*own)).join(model, "source_id").withColumn("phi", phase.phase(F.col("t"), F.col("P"), F.col("E"))).withColumn("m0", F.col("m0s")[F.col("band")]).withColumn("amp", F.col("amps")[F.col("band")])
    rows = rows.withColumn("residual", F.col("mag") - value(F.col("phi"))).select("source_id", "band", "phi", "residual", "m0", "amp", "A", "Q")
    key = ["source_id", "band"]
    cells = phase.with_gaps(rows).groupBy(*key, phase.bins(n_grid).alias("bin")).agg(F.count("*").alias("n"), F.max("gap").alias("gap"), how[statistic].alias("value"), F.first(F.struct("m0", "amp", "A", "Q")).alias("fit"))
    one = cells.groupBy(*key).agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.max("gap").alias("gap"), F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "value")))).alias("x"), F.first("fit").alias("fit"))
    p = lambda v: v["n"] / F.col("N")
    entropy = -F.aggregate(F.map_values("x"), F.lit(0.0), lambda s, v: s + p(v) * F.ln(p(v))) / F.ln(F.lit(float(n_grid)))
    grid = F.sequence(F.lit(0), F.lit(n_grid - 1))
    one = one.withColumns({c: F.col(f"fit.{c}") for c in ("m0", "amp", "A", "Q")})
    return one.select(
        F.col("source_id").alias("ID"), "band", "N", (F.col("k") / n_grid).alias("occupied_fraction"), F.when(F.col("N") < 2, 1.0).otherwise(F.col("gap")).alias("gmax"), entropy.alias("coverage_entropy"),
        F.transform(grid, lambda i: value(i / float(n_grid))).alias("fval_grid"), F.transform(grid, lambda i: F.try_element_at("x", i)["value"]).alias("residual_grid"),
        F.transform(grid, lambda i: F.map_contains_key("x", i).cast("tinyint")).alias("phase_mask"),
    )


TRIALS = 250  # of a block


def _block(cfg: EngineConfig, seed: int, sigma: float, snr: float):
    """The trials of one source, template and block: curves are drawn, searched and dropped in the task.

    Philox counters make the numbers of a trial depend on seed, source, template and
    trial alone. The times are those of the source, so all trials share their trigonometric sums.
    """

    def run(row: dict, curve: spectrum.Curve) -> list[tuple]:
        key = np.frombuffer(blake2b(f"{seed}|{row['source_id']}|{row['template']}".encode(), digest_size=16).digest(), np.uint64)
        trials = range(row["first"], row["last"])
        error = np.maximum(1 / np.sqrt(np.where(curve.w > 0, curve.w, np.inf)), cfg.err_floor)  # what weighs nothing may have any value
        band = np.empty(len(curve.t), int)
        for b, s in curve.parts:
            band[s] = b
        sizes = dict(row["amplitudes"])
        own = [sizes.get(b) for b in row["bands"]]
        sure = [a for a in own if a and np.isfinite(a)]
        uniform, normal = np.empty((len(trials), 2)), np.empty((len(trials), 1 + len(curve.t)))
        bits = np.random.Philox(key=key)
        rng, fresh = np.random.Generator(bits), bits.state
        for i, trial in enumerate(trials):
            fresh["state"]["counter"][:] = 0, 0, 0, trial
            bits.state = fresh
            rng.random(out=uniform[i])
            rng.standard_normal(out=normal[i])
        low, high = np.log(cfg.pmin), np.log(cfg.pmax)
        periods = np.exp(low + (high - low) * uniform[:, 0])
        epochs, scales = periods * uniform[:, 1], np.exp(sigma * normal[:, 0])
        amplitude = np.array([a if a and np.isfinite(a) else sure[0] if sure else 1.0 for a in own])[band]
        values = np.empty((len(curve.t), len(trials)))
        some = max(1, spectrum.VALUES // len(curve.t))  # trials whose points are at hand together
        for i in range(0, len(trials), some):
            part = slice(i, i + some)
            phi = 2 * np.pi * ((curve.t - epochs[part, None]) / periods[part, None])
            shape = sum(a * np.cos(j * phi - q) for j, (a, q) in enumerate(zip(row["A"], row["Q"], strict=True), 1))
            values[:, part] = (amplitude * shape * (scales[part, None] if sure else 1.0) + error * normal[part, 1:]).T
        drawn = list(zip(trials, periods.tolist(), (epochs + row["t0"]).tolist(), scales.tolist(), strict=True))
        weighted = curve.w[:, None] * values
        sums = [np.zeros((curve.bands, len(trials))) for _ in range(2)]
        for b, s in curve.parts:
            sums[0][b] += weighted[s].sum(0)
            sums[1][b] += (weighted[s] * values[s]).sum(0)
        grid = np.concatenate([spectrum.power(curve.totals, *x, sums=sums) for _, *x in curve.blocks(row["fmin"], row["df"], row["nf"], values)])
        best, deviation = spectrum.highest(np.nan_to_num(grid), snr)
        some = np.flatnonzero(best >= 0)
        found = {}
        if len(some):
            f = row["fmin"] + row["df"] * best[some]
            values, sums = values[:, some], [x[:, some] for x in sums]
            close = periodogram.near(f, row["df"], cfg.pmin, cfg.pmax)
            f = np.where(row["df"] / f > cfg.period_tol, spectrum.refined(close, curve.own_power(close, values, sums, even=True)), f)
            z = curve.own_power(f[:, None], values, sums)[:, 0]
            found = {int(i): (1 / x, v) for i, x, v in zip(some, f.tolist(), z.tolist(), strict=True) if v > 3 * deviation[i]}
        out = []
        for i, (trial, period, epoch, scale) in enumerate(drawn):
            p, z = found.get(i, (None, None))
            out.append((row["template"], trial, period, epoch, scale, p, z, None if p is None else (p - period) / period))
        return out

    return run


def injection_recovery(epochs: DataFrame, templates: list[tuple[str, list[float], list[float]]], cfg: EngineConfig, periods: int = 200, repeats: int = 5, seed: int = 0, sigma: float = 0.1, snr: float = 3.0) -> DataFrame:
    """Synthetic curves on each source's own sampling: known period, found period and relative error.

    ``periods`` times ``repeats`` trials of every source and template (``name, A, Q``), each with a period drawn
    log-uniformly from the range, an epoch, the source's own amplitudes by band (from clipped
    points; a band without one takes the first other band's) times a log-normal factor, and noise. What is sent to
    a task is a source's points once for each template and block of ``TRIALS`` trials; nothing of
    the curves is written. Reruns agree on any cluster. A trial without a significant peak has a null period.
    """
    points = epochs.where(F.col("band").isin(*cfg.activated))
    sized = stats.amplitude(stats.sigma_clip(points, 3.0)).groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "amp"))).alias("amplitudes"))
    kinds = F.array(*(F.struct(F.lit(n).alias("template"), F.array(*map(F.lit, a)).alias("A"), F.array(*map(F.lit, q)).alias("Q")) for n, a, q in templates))
    count = periods * repeats
    blocks = F.sequence(F.lit(0), F.lit(count - 1), F.lit(TRIALS))
    rows = periodogram.curves(points, cfg.n0, cfg.pmin, cfg.pmax, points=1 << 40).join(sized, "source_id")
    tasks = rows.withColumn("x", F.explode(kinds)).withColumn("first", F.explode(blocks)).withColumn("last", F.least(F.col("first") + TRIALS, F.lit(count)))
    tasks = tasks.select("*", "x.*").drop("x")
    return periodogram.over_curves(spread(tasks, "source_id", "template", "first"), "template string, trial int, P_true double, E_true double, ampl_scale double, P_recon double, Z_recon double, rel_err double", _block(cfg, seed, sigma, snr))
