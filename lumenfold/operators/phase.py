"""Folding, gaps, histograms and coverage by phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("source_id", "band")


def phase(t: Column, period: Column, epoch: Column | float = 0.0) -> Column:
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.pmod((t - epoch) / period, F.lit(1.0))


def expand(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Copies of each point at whole shifts of its phase ``phi`` within [low, high]."""
    shift = F.explode(F.sequence(F.floor(F.lit(low)), F.ceil(F.lit(high)) - 1))
    return rows.withColumn("n", shift).withColumn("phi", F.col("phi") + F.col("n")).where(F.col("phi").between(low, high)).drop("n")


def with_gaps(rows: DataFrame) -> DataFrame:
    """Add ``gap``, the circular distance from ``phi`` to the next point of the source and band."""
    w = W.partitionBy(*KEY).orderBy("phi")
    return rows.withColumn("gap", F.coalesce(F.lead("phi").over(w), F.min("phi").over(W.partitionBy(*KEY)) + 1) - F.col("phi"))


def gap_max(rows: DataFrame, least: int = 0) -> DataFrame:
    """Largest circular gap of ``phi`` by source and band; 1 with fewer than ``least`` or 2 points."""
    return with_gaps(rows).groupBy(*KEY).agg(F.when(F.count("*") < max(least, 2), 1.0).otherwise(F.max("gap")).alias("gmax"))


def bins(n_grid: int = 50) -> Column:
    return F.least(F.floor(F.col("phi") * n_grid), F.lit(n_grid - 1)).cast("int")


def histogram(rows: DataFrame, n_grid: int = 50) -> DataFrame:
    return rows.groupBy(*KEY, bins(n_grid).alias("bin")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, n_grid: int = 50) -> DataFrame:
    """Occupied fraction, entropy (over ln n_grid) and effective number of points."""
    share = F.col("n") / F.sum("n").over(W.partitionBy(*KEY))
    return (
        histogram(rows, n_grid).withColumn("p", share).groupBy(*KEY)
        .agg(F.count("*").alias("k"), (-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(float(n_grid)))).alias("entropy"), F.sum("n").alias("total"))
        .select(*KEY, (F.col("k") / n_grid).alias("occupied_fraction"), "entropy", F.least(F.col("total").cast("double"), F.col("k").cast("double")).alias("n_eff"))
    )


def mask(rows: DataFrame, n_grid: int = 50) -> DataFrame:
    """Dense 0/1 rows ``bin, filled``: every bin of every source and band."""
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_grid - 1)), lambda b: F.struct(b.alias("bin"), F.array_contains("own", b).cast("int").alias("filled")))
    return rows.groupBy(*KEY).agg(F.collect_set(bins(n_grid)).alias("own")).select(*KEY, F.inline(dense))


def window_coverage(rows: DataFrame, width: int = 8, n_grid: int = 50) -> DataFrame:
    """Circular mean of the mask over ``width // 2`` bins to each side."""
    half = width // 2
    around = lambda b: F.aggregate(F.sequence(F.lit(-half), F.lit(half)), F.lit(0), lambda a, s: a + F.array_contains("own", F.pmod(b + s, F.lit(n_grid))).cast("int"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_grid - 1)), lambda b: F.struct(b.alias("bin"), (around(b) / (2 * half + 1)).alias("cover")))
    return rows.groupBy(*KEY).agg(F.collect_set(bins(n_grid)).alias("own")).select(*KEY, F.inline(dense))


def binned_residual(rows: DataFrame, n_grid: int = 50, statistic: str = "median") -> DataFrame:
    how = {"mean": F.avg("residual"), "median": F.percentile("residual", F.lit(0.5)), "rms": F.sqrt(F.avg(F.col("residual") * F.col("residual")))}
    if statistic not in how:
        raise ValueError(f"unknown statistic {statistic!r}")
    return rows.groupBy(*KEY, bins(n_grid).alias("bin")).agg(how[statistic].alias("value"))


def in_cyclic(phi: Column, start: Column, end: Column) -> Column:
    """Whether a phase is in the closed interval from start to end, which may wrap."""
    return F.when(start <= end, phi.between(start, end)).otherwise((phi >= start) | (phi <= end))
