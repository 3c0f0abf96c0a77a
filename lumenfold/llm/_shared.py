"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.tables import LEAST_TASKS, TASK_ROWS, dropped, saved

__all__ = ["ascii_lower", "bound", "connected_components", "crc_mod", "dropped", "saved", "sent", "size_of", "stars", "table", "unused"]
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, stem: str) -> str:
    """``stem``, or with underscores behind it until no column of ``df`` has the name."""
    while stem.lower() in (c.lower() for c in df.columns):
        stem += "_"
    return stem


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast from a few tasks if it has no more ``rows`` of a few numbers than one task may have."""
    return F.broadcast(df.coalesce(LEAST_TASKS)) if rows <= TASK_ROWS else df


def stars(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, int]:
    """Each node of an undirected edge list that isn't its component's smallest, with that one, and how many those are.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type and is read once. Returns a
    saved table ``node, root``. Alternates large-star and small-star steps (Kiveris et
    al., 2014) as joins on the node, until every node has either one smaller neighbour or
    none. Self loops and repeated edges are harmless. The tables of a step whose edges are
    few are broadcast.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        rows = e.count()
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(e.select("v", F.lit(None)))
        tangled = ends.groupBy("node").agg(F.count("*").alias("ends"), F.count("up").alias("ups")).where("ups > 0 and ends > 1")
        if (tangled.coalesce(LEAST_TASKS) if rows <= TASK_ROWS else tangled).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")), rows
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(sent(low, rows), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if rows > TASK_ROWS:
            large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(low, rows), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = saved(small, rows=2 * rows)
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge list with its component's smallest node.

    Returns ``node, root``, for nodes that have an edge to another node (``stars``).
    """
    found, _ = stars(edges, max_rounds)
    return found.union(found.select("root", "root").distinct())


def ascii_lower(text: Column) -> Column:
    """Lower A-Z only. ``lower`` is much faster than ``translate`` and the same on ASCII texts."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable isn't inlined as a column may be."""
    return F.transform(F.array(value), body)[0]


def size_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    trimmed = F.regexp_replace(text, rf"^{WORD_BREAK}|{WORD_BREAK}\z", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_BREAK))).cast("long")
