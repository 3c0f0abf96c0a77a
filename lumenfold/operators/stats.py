"""Weighted statistics, clipping and scores by source and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.operators.phase import in_cyclic

KEY = ("source_id", "band")
#: a middling magnitude, from which sums are taken
SHIFT = 20.0


def weight(floor: float = 0.001) -> Column:
    e = F.greatest(F.col("emag"), F.lit(floor))
    return 1 / (e * e)


def per_weight(total: Column, w: Column) -> Column:
    """A weighted sum over the sum of weights; NaN where nothing weighs, as all errors are infinite."""
    return F.when((w == 0) & total.isNotNull(), F.lit(float("nan"))).otherwise(F.try_divide(total, w))


def weighted_mean_rms(rows: DataFrame, floor: float = 0.001) -> DataFrame:
    """``n, m0, rms`` with weights 1/max(emag, floor)^2, from sums over one scan; values are shifted by a constant near all magnitudes to keep the digits."""
    w, d = weight(floor), F.col("mag") - SHIFT
    s = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * d).alias("d"), F.sum(w * d * d).alias("dd"))
    mean = per_weight(F.col("d"), F.col("w"))
    return s.select(*KEY, "n", (mean + SHIFT).alias("m0"), F.sqrt(F.greatest(per_weight(F.col("dd"), F.col("w")) - mean * mean, F.lit(0.0))).alias("rms"))


def amplitude(rows: DataFrame) -> DataFrame:
    p = F.percentile("mag", F.array(F.lit(0.01), F.lit(0.99)))
    return rows.groupBy(*KEY).agg((p[1] - p[0]).alias("amp"))


def sigma_clip(rows: DataFrame, sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """Drop points farther than ``sigma`` population deviations from the median, at most ``rounds`` times.

    Every round is two aggregates over one partitioning by source and band, so that
    all rounds share a single exchange; a dropped point stays as a null till the end.
    """
    w = W.partitionBy(*KEY)
    out = rows.withColumn("clipped", F.col("mag"))
    for _ in range(rounds):
        out = out.withColumn("mid", F.median("clipped").over(w)).withColumn("sd", F.stddev_pop("clipped").over(w))
        out = out.withColumn("clipped", F.when(F.abs(F.col("clipped") - F.col("mid")) <= sigma * F.col("sd"), F.col("clipped")))
    return out.where("clipped is not null").drop("clipped", "mid", "sd")


def axis_limits(rows: DataFrame) -> DataFrame:
    """Robust limits of a magnitude axis: range with errors, held to two deviations and a quarter amplitude."""
    amp = F.max("mag") - F.min("mag")
    high = F.least(F.max(F.col("mag")) + 1.5 * F.max("emag"), F.avg("mag") + 2 * F.stddev_pop("mag") + 0.25 * F.abs(amp))
    low = F.greatest(F.min(F.col("mag")) - 1.5 * F.max("emag"), F.avg("mag") - 2 * F.stddev_pop("mag") - 0.25 * F.abs(amp))
    return rows.groupBy(*KEY).agg(low.alias("low"), high.alias("high"))


def brightest_epoch(rows: DataFrame) -> DataFrame:
    """Time of the smallest magnitude of each band, the first on ties."""
    return rows.groupBy(*KEY).agg(F.min_by("t", F.struct("mag", "ord")).alias("t0"))


def refit(rows: DataFrame, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Weighted (m0, amp) of ``mag ~ m0 + amp * h``, null where h is flat or nothing weighs; with ``bounds`` the amplitude is held and m0 follows."""
    w = weight()
    s = rows.withColumn("w", w).groupBy(*KEY).agg(*(F.sum(e).alias(a) for a, e in {"sw": F.col("w"), "sh": F.col("w") * F.col("h"), "shh": F.col("w") * F.col("h") * F.col("h"), "sy": F.col("w") * F.col("mag"), "shy": F.col("w") * F.col("h") * F.col("mag")}.items()))
    amp = F.try_divide(F.col("sw") * F.col("shy") - F.col("sh") * F.col("sy"), F.col("sw") * F.col("shh") - F.col("sh") * F.col("sh"))
    if bounds:
        amp = F.when(amp.isNotNull(), F.least(F.greatest(amp, F.lit(bounds[0])), F.lit(bounds[1])))
    return s.withColumn("amp", amp).select(*KEY, per_weight(F.col("sy") - F.col("amp") * F.col("sh"), F.col("sw")).alias("m0"), "amp")


def chi2_reduced(rows: DataFrame, n_dim: int, floor: float = 0.001) -> DataFrame:
    """Sum of squared normalised residuals over (N - n_dim) by source; infinite without degrees of freedom."""
    z = F.col("residual") / F.greatest(F.col("emag"), F.lit(floor))
    return rows.groupBy("source_id").agg(F.when(F.count("*") > n_dim, F.sum(z * z) / F.greatest(F.lit(1), F.count("*") - n_dim)).otherwise(float("inf")).alias("chi2"))


def huber(z: Column, delta: float = 2.5) -> Column:
    a = F.abs(z)
    return F.when(a <= delta, 0.5 * z * z).otherwise(delta * (a - 0.5 * delta))


def bic(chi2: Column, n: Column, k: Column) -> Column:
    return chi2 * F.greatest(n - k, F.lit(1.0)) + k * F.ln(F.greatest(n, F.lit(1.0)))


def bic_tolerance(n_eff: Column, k: Column, chi2: Column, c: float = 0.1) -> Column:
    return F.greatest(F.lit(2.0), c * F.sqrt(2 * F.greatest(n_eff - k, F.lit(1.0))) * F.greatest(F.lit(1.0), chi2))


def adaptive_lambda(gmax: Column, m: Column, n: Column, lam: tuple[float, float, float] = (1e-2, 1e-4, 5e-2)) -> Column:
    raw = lam[0] * F.pow(F.greatest(gmax, F.lit(0.05)) / 0.12, F.lit(3.0)) * F.pow(m / 5.0, F.lit(2.0)) * (30.0 / F.greatest(n, F.lit(10.0)))
    return F.least(F.greatest(raw, F.lit(lam[1])), F.lit(lam[2]))


def residual_autocorrelation(rows: DataFrame, least: int) -> DataFrame:
    """|lag-1 correlation| of residuals by phase, averaged over bands by their points; 0 if none is defined."""
    w = W.partitionBy(*KEY).orderBy("phi", "ord")
    z = F.col("residual") / F.greatest(F.col("emag"), F.lit(0.001))
    pairs = rows.withColumn("z", z).withColumn("next", F.lead("z").over(w))
    both = F.col("next").isNotNull()
    a, b = F.when(both, F.col("z")), F.col("next")
    rho = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    s = pairs.groupBy(*KEY).agg(F.count("*").alias("n"), F.abs(rho).alias("r")).where(f"n >= {least}")
    return s.groupBy("source_id").agg(F.coalesce(F.try_divide(F.sum(F.col("r") * F.col("n")), F.sum(F.when(F.col("r").isNotNull(), F.col("n")))), F.lit(0.0)).alias("rho"))


def order_autocorrelation(rows: DataFrame, floor: float = 0.001) -> DataFrame:
    """``source_id, m, rho``: the same for several orders ``m`` of a source; bands of fewer than m + 2 points are left out."""
    key = ["source_id", "m", "band"]
    w = W.partitionBy(*key).orderBy("phi", "ord")
    pairs = rows.withColumn("z", F.col("residual") / F.greatest(F.col("emag"), F.lit(floor))).withColumn("next", F.lead("z").over(w))
    a, b = F.when(F.col("next").isNotNull(), F.col("z")), F.col("next")
    r = F.abs(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    s = pairs.groupBy(*key).agg(F.count("*").alias("n"), r.alias("r")).where("n >= m + 2 and r is not null")
    return s.groupBy("source_id", "m").agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("rho"))


def slope_penalty(rows: DataFrame, key: list[str], bins: int = 5, least: int = 5, delta: float = 2.5, least_bin: int = 2) -> DataFrame:
    """``key, slope``: how far the branches between peak and trough lie from the model as a whole.

    ``rows`` has ``key, band, phi, z`` (residual over its error), ``peak`` and ``trough``.
    Each branch is cut into ``bins`` by band; the bins' mean ``z``, held to 8, go through
    Huber's loss and are averaged by their counts. Branches of fewer than ``least``
    points and bins of fewer than ``least_bin`` are left out; 0 without any.
    """
    z = F.least(F.greatest("z", F.lit(-8.0)), F.lit(8.0))
    ends = F.explode(F.array(*(F.struct(F.lit(i).alias("branch"), F.col(a).alias("from"), F.col(b).alias("to")) for i, (a, b) in enumerate((("peak", "trough"), ("trough", "peak"))))))
    rows = rows.withColumn("zc", z).withColumn("x", ends).select(*key, "band", "phi", "zc", "x.*").where(in_cyclic(F.col("phi"), F.col("from"), F.col("to")))
    width = F.pmod(F.col("to") - F.col("from"), F.lit(1.0))
    at = F.floor(F.try_divide(F.pmod(F.col("phi") - F.col("from"), F.lit(1.0)), width) * bins)
    rows = rows.withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)))
    cells = rows.groupBy(*key, "branch", "band", "bin").agg(F.count("*").alias("n"), F.avg("zc").alias("mean"))
    branch = cells.groupBy(*key, "branch").agg(F.sum("n").alias("points"), F.sum(F.when(F.col("n") >= least_bin, F.col("n"))).alias("used"), F.sum(F.when(F.col("n") >= least_bin, F.col("n") * huber(F.col("mean"), delta))).alias("loss"))
    return branch.where(f"points >= {least} and used > 0").groupBy(*key).agg((F.sum("loss") / F.sum("used")).alias("slope"))


def chi2_band(rows: DataFrame, floor: float = 0.001) -> DataFrame:
    """Sum of squared normalised residuals by source and band, not reduced."""
    z = F.col("residual") / F.greatest(F.col("emag"), F.lit(floor))
    return rows.groupBy(*KEY).agg(F.sum(z * z).alias("chi2"))


def chi2_level(rows: DataFrame, floor: float = 0.001) -> DataFrame:
    """The same over N - 2, for a fitted level and amplitude; null with two points or fewer."""
    z = F.col("residual") / F.greatest(F.col("emag"), F.lit(floor))
    return rows.groupBy(*KEY).agg(F.try_divide(F.sum(z * z), F.greatest(F.count("*") - 2, F.lit(0))).alias("chi2"))


def select_order(scores: DataFrame, tie_breaker: str = "minimum") -> DataFrame:
    """Per source one ``m`` whose ``score`` is within ``tol`` of the best one's: ``source_id, m, score``.

    ``tie_breaker``: the smallest ``m``, or with ``M_trunc`` the one nearest to the column ``trunc``, of two
    the smaller.
    """
    w = W.partitionBy("source_id")
    best = F.min(F.struct("score", "m", "tol")).over(w)
    near = scores.withColumn("best", best).where("score - best.score <= best.tol")
    rank = F.struct(F.abs(F.col("m") - F.col("trunc")), "m") if tie_breaker == "M_trunc" else F.struct("m")
    return near.groupBy("source_id").agg(F.min_by("m", rank).alias("m"), F.min_by("score", rank).alias("score"))


def truncation_order(coefficients: DataFrame, share: float = 0.98) -> DataFrame:
    """First order ``j`` at which the summed squares of ``A`` reach ``share`` of all."""
    w = W.partitionBy("source_id")
    power = F.col("A") * F.col("A")
    part = F.sum(power).over(w.orderBy("j").rowsBetween(W.unboundedPreceding, 0)) / F.sum(power).over(w)
    return coefficients.withColumn("part", part).where(F.col("part") >= share).groupBy("source_id").agg(F.min("j").alias("m_trunc"))
