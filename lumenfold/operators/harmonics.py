"""Fourier models: conversions, evaluation, penalties, trigonometric moments and least squares."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import fit
from lumenfold.operators.stats import per_weight
from lumenfold.sources.tables import spread

TAU = 2 * math.pi


def aq_to_ab(A: Column, Q: Column) -> tuple[Column, Column]:
    return A * F.cos(Q), A * F.sin(Q)


def ab_to_aq(a: Column, b: Column) -> tuple[Column, Column]:
    return F.hypot(a, b), F.pmod(F.atan2(b, a), F.lit(TAU))


def design_row(phi: Column, order: int) -> Column:
    """1, cos, sin of each order up to ``order``."""
    pair = lambda j: F.array(F.cos(TAU * j * phi), F.sin(TAU * j * phi))
    return F.concat(F.array(F.lit(1.0)), F.flatten(F.transform(F.sequence(F.lit(1), F.lit(order)), pair)))


def template(phi: Column, a: list[float], b: list[float]) -> Column:
    """Sum of ``a_j cos + b_j sin``; literal coefficients stay in generated code."""
    out = F.lit(0.0)
    for j, (x, y) in enumerate(zip(a, b, strict=True), 1):
        out = out + x * F.cos(TAU * j * phi) + y * F.sin(TAU * j * phi)
    return out


def template_arrays(phi: Column, a: Column, b: Column) -> Column:
    """The same with array columns."""
    term = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    term = F.transform(term, lambda c, i: c["x"] * F.cos(TAU * (i + 1) * phi) + c["y"] * F.sin(TAU * (i + 1) * phi))
    return F.aggregate(term, F.lit(0.0), lambda s, v: s + v)


def model(phi: Column, m0: Column, amp: Column, A: Column, Q: Column) -> Column:
    """``m0 + amp`` times the sum of ``A_j cos(2 pi j phi - Q_j)``, amplitudes and phases as arrays."""
    terms = F.transform(F.zip_with(A, Q, lambda a, q: F.struct(a.alias("a"), q.alias("q"))), lambda c, j: c["a"] * F.cos(TAU * (j + 1) * phi - c["q"]))
    return m0 + amp * F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def model_grid(models: DataFrame, n: int = 200) -> DataFrame:
    """``name, i, h``: models ``name, a, b, P, E`` of unit amplitude at ``n`` steps of a cycle, shifted by the epoch's share of its period."""
    rows = models.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    shift = F.pmod(F.col("E") / F.col("P"), F.lit(1.0))
    return rows.select("name", "i", template_arrays(F.col("i") / float(n) - shift, F.col("a"), F.col("b")).alias("h"))


def on_grid(templates: DataFrame, n: int, closed: bool = False) -> DataFrame:
    """``name, i, phi, h`` of templates ``name, a, b`` on n steps (and 1 itself if closed)."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(n if closed else n - 1)))
    return templates.withColumn("i", grid).withColumn("phi", F.col("i") / float(n)).select("name", "i", "phi", template_arrays(F.col("phi"), F.col("a"), F.col("b")).alias("h"))


#: templates whose values on the grid are held at once
TOGETHER = 256


def _between(h: np.ndarray, first: float, last: float) -> np.ndarray:
    """By row, from one quantile to another, each between the two nearest values; ``h`` is put in another order."""
    at = [q * (h.shape[1] - 1) for q in (first, last)]
    h.partition(sorted({f(x) for x in at for f in (math.floor, math.ceil)}), axis=1)
    low, high = (h[:, math.floor(x)] + (x - math.floor(x)) * (h[:, math.ceil(x)] - h[:, math.floor(x)]) for x in at)
    return high - low


def _coefficients(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``width`` numbers for each list, zeros behind its own, and its length, or -1 if it is null or holds a null."""
    length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten()
    out, own = np.zeros((len(column), width)), np.repeat(np.arange(len(column)), np.maximum(length, 0))
    place = np.arange(len(own)) - np.repeat(np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0), np.maximum(length, 0))
    out[own, place] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    length[own[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, length


def peak_to_peak(templates: DataFrame, n: int = 1000) -> DataFrame:
    """``name, ptp``: from the first to the 99th percentile of templates ``name, a, b`` on ``n`` steps of a cycle and its end.

    Values are made and ranked in blocks inside the task, so a template is one row throughout; those of
    the same name are ranked together, and one with a null coefficient has no values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            count, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
            width = max((max(flat.field(c).value_lengths().drop_null().to_pylist(), default=0) for c in "ab"), default=0)
            (a, in_a), (b, in_b) = (_coefficients(flat.field(c), width) for c in "ab")
            fine = (in_a >= 0) & (in_a == in_b)
            wave, edges = fit.harmonics(np.arange(n + 1) / n, width).T, np.concatenate([[0], np.cumsum(count)])
            out = np.full(len(batch), np.nan)
            known = np.add.reduceat(np.append(fine, False), edges[:-1]) if len(batch) else np.zeros(0)
            alone = np.flatnonzero((count == 1) & (known == 1))
            each = [alone[i : i + TOGETHER] for i in range(0, len(alone), TOGETHER)] + [np.array([i]) for i in np.flatnonzero((count > 1) & (known > 0))]
            for rows in each:
                own = edges[rows] if len(rows) > 1 or count[rows[0]] == 1 else np.arange(edges[rows[0]], edges[rows[0] + 1])
                own = own[fine[own]]
                h = (np.hstack([a[own], b[own]]) @ wave).reshape(len(rows), -1)
                out[rows] = _between(h, 0.01, 0.99)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, mask=known == 0)], names=["name", "ptp"])

    lists = spread(templates, "name").groupBy("name").agg(F.collect_list(F.struct("a", "b")).alias("x"))
    return lists.mapInArrow(run, f"name {dict(templates.dtypes)['name']}, ptp double")


def spike_penalty(templates: DataFrame, n: int = 50) -> DataFrame:
    """p99 of |second circular difference| squared, plus a twentieth of its mean square."""
    own = on_grid(templates, n).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("f"))
    d2 = F.transform("f", lambda v, i: F.get("f", F.pmod(i + 1, F.lit(n))) - 2 * v + F.get("f", F.pmod(i - 1, F.lit(n))))
    rows = own.select("name", F.explode(d2).alias("d"))
    return rows.groupBy("name").agg((F.pow(F.percentile(F.abs("d"), F.lit(0.99)), F.lit(2.0)) + 0.05 * F.avg(F.col("d") * F.col("d"))).alias("spike"))


def harmonic_penalty(a: Column, b: Column, power: float = 4.0) -> Column:
    terms = F.transform(F.zip_with(a, b, lambda x, y: x * x + y * y), lambda v, i: F.pow((i + 1).cast("double"), F.lit(power)) * v)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def moments(rows: DataFrame, order: int, floor: float = 0.001) -> DataFrame:
    """Sums by source, band and k of weights and weighted values with cos and sin of k phi; k to 2 ``order``.

    All that least squares of every order up to ``order`` needs, from one scan.
    """
    e = F.greatest(F.col("emag"), F.lit(floor))
    rows = rows.withColumn("w", 1 / (e * e)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * order)))).withColumn("x", TAU * F.col("k") * F.col("phi"))
    w, y = F.col("w"), F.col("mag")
    return rows.groupBy("source_id", "band", "k").agg(F.sum(w * F.cos("x")).alias("C"), F.sum(w * F.sin("x")).alias("S"), F.sum(w * y * F.cos("x")).alias("YC"), F.sum(w * y * F.sin("x")).alias("YS"))


def unpack_theta(theta: Column, bands: int, order: int, with_amp: bool = True) -> Column:
    """``struct<m0, amp, c1, c2, P, E>`` of a parameter vector ``[m0 x bands, amp x bands, c1 x order, c2 x order, P, E]``."""
    amp = F.slice(theta, bands + 1, bands) if with_amp else F.array_repeat(F.lit(1.0), bands)
    at = bands * (2 if with_amp else 1)
    return F.struct(F.slice(theta, 1, bands).alias("m0"), amp.alias("amp"), F.slice(theta, at + 1, order).alias("c1"), F.slice(theta, at + order + 1, order).alias("c2"), F.element_at(theta, -2).alias("P"), F.element_at(theta, -1).alias("E"))


def wls_first_order(rows: DataFrame) -> DataFrame:
    """``m0, a1, b1`` of one harmonic by weighted least squares, from centred sums in closed form."""
    e = F.greatest(F.col("emag"), F.lit(0.001))
    rows = rows.withColumn("w", 1 / (e * e)).withColumn("c", F.cos(TAU * F.col("phi"))).withColumn("s", F.sin(TAU * F.col("phi")))
    w, c, s, y = F.col("w"), F.col("c"), F.col("s"), F.col("mag")
    g = rows.groupBy("source_id", "band").agg(F.count("*").alias("n"), F.sum(w).alias("W"), *(per_weight(F.sum(w * v), F.sum(w)).alias(k) for k, v in {"c": c, "s": s, "y": y, "cc": c * c, "ss": s * s, "cs": c * s, "yc": y * c, "ys": y * s}.items())).where("n >= 4")
    at = lambda k, l, m: F.col(k) - F.col(l) * F.col(m)  # noqa: E731, E741
    g = g.select("source_id", "band", "y", F.col("c").alias("mc"), F.col("s").alias("ms"), at("cc", "c", "c").alias("vcc"), at("ss", "s", "s").alias("vss"), at("cs", "c", "s").alias("vcs"), at("yc", "y", "c").alias("vyc"), at("ys", "y", "s").alias("vys"))
    d = F.col("vcc") * F.col("vss") - F.col("vcs") * F.col("vcs")
    a = F.try_divide(F.col("vss") * F.col("vyc") - F.col("vcs") * F.col("vys"), d)
    b = F.try_divide(F.col("vcc") * F.col("vys") - F.col("vcs") * F.col("vyc"), d)
    return g.withColumns({"a1": a, "b1": b}).select("source_id", "band", (F.col("y") - F.col("a1") * F.col("mc") - F.col("b1") * F.col("ms")).alias("m0"), "a1", "b1")
