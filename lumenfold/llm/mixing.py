"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

The rate of a document of ``s`` words is ``r(z) = 3 / (1 + 2 exp(-z))`` with
``z = lambda * s / mean``: rates next to 1 in bounded entropy, exponentially
tilted, so that the words of a source meet its target. The dual is convex and
has one ``lambda`` for each source; a guarded Newton step of all sources is one
aggregation over the (source, size) counts. Rates are then rounded to whole
copies by cumulative rounding over the sizes, the rest is put right with copies
of one fitting size, and copies of equal documents are dealt by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm._shared import saved, size_of

WEIGHTS, MOST, SALTS, ROUNDS = (5.0, 2.0, 1.0), 3, 256, 40
#: share of a target that rounding may miss after the last round
LOOSE = 1e-3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, a row for each source.

    Sources by code point, null last, have the weights in turn. Targets share all
    words and stop at ``most`` times the source's words; what is above is reshared
    by weight: the level is found in one pass over the sources by their bound.
    Windows see one row for each source, not the documents.
    """
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("limit", F.col("source_size") * float(most))
    by_bound = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_bound.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    s = s.withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(by_bound.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.col("stopped")) / F.col("open"))
    free = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct((F.col("limit") / F.col("w")).alias("bound"), (-F.col("level")).alias("down")))
    s = s.withColumn("level", -F.min(free).over(everything)["down"])  # of the first source that stays below its bound
    return s.select("source", "source_size", F.when(F.col("level").isNotNull(), F.least("limit", F.col("level") * F.col("w"))).otherwise(F.col("limit")).alias("target"))


def _rate(most: float):
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-F.greatest(F.lit(-600.0), F.least(F.lit(600.0), F.col("lam") * F.col("x")))))


def tilts(counts: DataFrame, targets: DataFrame, most: float = MOST, rounds: int = ROUNDS, tol: float = 1e-7) -> DataFrame:
    """``source, lam, mean``: the dual's solution, by Newton steps kept within a bracket; an error if it isn't found in ``rounds``."""
    sums = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = targets.join(sums.withColumnRenamed("source", "s_"), F.expr("source <=> s_")).drop("s_")
    state = saved(state.select("source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full")))
    for _ in range(rounds):
        at = counts.join(state.select(F.col("source").alias("s_"), "lam", "mean"), F.expr("source <=> s_")).withColumn("x", F.col("size") / F.col("mean")).withColumn("r", _rate(most))
        got = at.groupBy("s_").agg(F.sum(F.col("n") * F.col("size") * F.col("r")).alias("g"), F.sum(F.col("n") * F.col("size") * F.col("x") * F.col("r") * (1 - F.col("r") / most)).alias("dg"))
        step = state.join(got, F.expr("source <=> s_")).drop("s_").withColumn("off", F.col("g") - F.col("target"))
        step = step.withColumn("lo", F.when(F.col("off") < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("off") > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
        # on the logit of the filled share, which is nearly straight in lambda
        top = F.col("source_size") * float(most)
        gap = F.ln(F.col("g") / (top - F.col("g"))) - F.ln(F.col("target") / (top - F.col("target")))
        newton = F.col("lam") - F.try_divide(gap * F.col("g") * (top - F.col("g")), F.col("dg") * top)
        newton = F.when((F.col("g") > 0) & (F.col("g") < top) & (F.col("target") < top), newton)
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        wide = F.when(F.col("hi") >= 1e6, F.greatest(F.lit(1.0), F.col("lam") * 2 + 1)).when(F.col("lo") <= -1e6, F.least(F.lit(-1.0), F.col("lam") * 2 - 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.col("full") | (F.abs("off") <= F.col("target") * tol)
        state = saved(step.select("source", "source_size", "target", "mean", F.when(done, F.col("lam")).when(inside, newton).otherwise(wide).alias("lam"), "lo", "hi", "full", done.alias("done"), F.when(done, 0.0).otherwise(F.abs("off") / F.col("target")).alias("miss")))
        if state.where("not done").isEmpty():
            break
    else:
        if not state.where(f"miss > {LOOSE}").isEmpty():
            raise RuntimeError(f"weights of a source are not within {LOOSE} of their target after {rounds} rounds")
    return state.select("source", F.when(F.col("full"), F.lit(1e9)).otherwise(F.col("lam")).alias("lam"), "mean")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, salts: int = SALTS, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, then the columns ``keep``, one row per input row.

    ``taken`` is the document's words times its whole copies, from 0 to ``most``.
    A null or empty text has size 0 and takes 0; a null source is a source of its
    own, the last; repeated rows are documents of their own. Depends on the rows
    alone, so reruns agree. Other columns are ignored; an empty table gives none.
    """
    keep = keep or []
    if {c.lower() for c in keep} & {"doc_id", "size", "source_size", "target", "taken"}:
        raise ValueError("a column to keep has the name of a result")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("key")  # never null, so that joins and windows share a partitioning
    light = ["doc_id", "source", key, size_of(F.col("text")).alias("size"), salt]
    # columns to keep aren't written here: they go through the one exchange of the last join
    sized = docs.select(*light, F.struct(*(F.col(f"`{c}`").alias(c) for c in keep)).alias("kept")) if keep else saved(docs.select(*light))
    cells = saved(sized.groupBy("source", "size", "salt").agg(F.count("*").alias("own")))
    counts = saved(cells.groupBy("source", "size").agg(F.sum("own").alias("n")))
    targets = saved(source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))
    used = counts.where("size > 0")
    named = lambda df: df.withColumnRenamed("source", "s_")
    ideal = used.join(named(tilts(used, targets, most)), F.expr("source <=> s_")).drop("s_").withColumn("x", F.col("size") / F.col("mean"))
    ideal = ideal.select("source", "size", "n", (F.col("n") * _rate(most)).alias("ideal"))
    by_size = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0)
    ideal = ideal.withColumn("sum", F.sum("ideal").over(by_size))
    copies = ideal.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * most, (F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("ideal") + 0.5)))))
    copies = saved(copies.select("source", "size", "n", "copies"))
    rest = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("now")).join(named(targets), F.expr("source <=> s_")).select("s_", (F.col("target") - F.col("now")).alias("short"))
    fix = copies.join(rest, F.expr("source <=> s_")).withColumn("change", F.round(F.col("short") / F.col("size")).cast("long"))
    fix = fix.where("change <> 0 and copies + change between 0 and n * " + str(most)).groupBy("s_").agg(F.min_by("change", "size").alias("change"), F.min("size").alias("z_"))
    copies = copies.join(fix, F.expr("source <=> s_ and size = z_"), "left").select("source", "size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))
    # the copies over the whole ones of a size go to the first documents by hash, salt by salt
    by_salt = W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)
    quota = cells.withColumn("end", F.sum("own").over(by_salt)).join(copies.withColumnsRenamed({"source": "s_", "size": "z_"}), F.expr("source <=> s_ and size = z_"), "left")
    over = F.expr("copies % n")
    quota = quota.join(named(targets).withColumnRenamed("s_", "s2_"), F.expr("source <=> s2_")).select(
        key, "size", "salt", "source_size", "target", F.expr("copies div n").alias("all"),
        (F.floor(over * F.col("end") / F.col("n")) - F.floor(over * (F.col("end") - F.col("own")) / F.col("n"))).alias("more"),
    )
    rank = F.row_number().over(W.partitionBy("key", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit("copies")), "doc_id"))
    out = sized.withColumn("rank", rank).join(quota, ["key", "size", "salt"])
    taken = F.coalesce(F.col("size") * (F.col("all") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)), F.lit(0)).cast("long")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), *(F.col("kept").getField(c).alias(c) for c in keep))
