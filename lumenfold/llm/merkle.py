"""A Merkle manifest of a dataset: a tree over the rows of each source, and one over the sources.

A leaf is the digest of a row. Within a source, leaves stand in order; three
consecutive nodes (or what is left at the end) become one, until one is left, the
source's subroot; subroots, in order of the source, become the root in the same way.

Rows get their place by a range shuffle and the counts of its partitions, so no task
sees a whole source. Nodes are dealt by superblock, ``3 ** DEPTH`` consecutive nodes of
a source: a first pass reduces every superblock to its one node, and so on, up to the
root; on the way down the nodes of a superblock are cogrouped with the few outer nodes
that its proofs need, and in that one group finish the reduction, join the proofs and fold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm._shared import saved

ARITY, DEPTH = 3, 7
#: fields of a document that its leaf covers
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """sha256 in hex of the fields one after the other: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)).cast("binary"), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with the place ``pos`` (from 0) of each row among those of its ``group`` and their number ``n``.

    Rows that tie in ``order`` are told apart by where they were read, so that equal rows
    spread over partitions too. The numbers of a group come from those of its range partitions.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = batch.column(group)
            runs = pc.run_end_encode(keys) if len(keys) else None
            places, start = [], 0
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True) if runs is not None else ():
                seen = seen if key == last else 0
                places.extend(range(seen, seen + end - start))
                last, seen, start = key, seen + end - start, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(keys), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])

    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = saved(tied.repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie").mapInArrow(count, f"{kinds}, part int, place long"))
    sizes = placed.groupBy(group, "part").agg(F.count("*").alias("own"))  # partitions + groups rows
    w = W.partitionBy(group)
    before = sizes.select(group, "part", (F.sum("own").over(w.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(w).alias("n"))
    return placed.join(before, [group, "part"]).withColumn("pos", F.col("place") + F.col("before")).drop("part", "place", "before")


def reduced(nodes: list[str], whole: bool, depth: int) -> list[list[str]]:
    """The levels over ``nodes``: ``depth`` of them, or if these are ``whole``, all of a group, as many as lead to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= depth:
        own = levels[-1]
        levels.append([digest(*own[i : i + ARITY]) for i in range(0, len(own), ARITY)])
    return levels


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """The one node of each superblock as a node of the next level: ``grp, pos, n, h``."""
    size = ARITY**depth

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n = int(pdf["n"].iloc[0])
        top = reduced(pdf["h"].tolist(), n <= size, depth)[-1][0]
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "pos": pdf["block"].iloc[:1], "n": [-(-n // size)], "h": [top]})

    return nodes.select("grp", "pos", "n", "h").withColumn("block", F.floor(F.col("pos") / size)).groupBy("grp", "block").applyInPandas(run, "grp string, pos long, n long, h string")


_PATH = "before array<string>, after array<string>"


def _proved(nodes: DataFrame, outer: DataFrame, depth: int, kinds: str, finish) -> DataFrame:
    """Cogroup the nodes of each superblock with its outer nodes.

    ``outer``: ``grp, block``, the source's ``subroot`` and, level by level from the superblock
    up to the root, the digests before and after the one on the way, joined.
    ``finish(rows, before, after)`` gives the result's columns, ``kinds``, from the rows in order,
    the subroot beside them, and the levels of each.
    """
    size = ARITY**depth

    def run(pdf: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True).assign(subroot=way["subroot"].iloc[0])
        levels = reduced(pdf["h"].tolist(), int(pdf["n"].iloc[0]) <= size, depth)
        up, down = list(way["before"].iloc[0]), list(way["after"].iloc[0])
        sides = []  # of each level, what stands before and after each node in its run
        for own in levels[:-1]:
            runs = [own[i - i % ARITY : i - i % ARITY + ARITY] for i in range(len(own))]
            sides.append((["".join(r[: i % ARITY]) for i, r in enumerate(runs)], ["".join(r[i % ARITY + 1 :]) for i, r in enumerate(runs)]))
        before = [[s[0][i // ARITY**k] for k, s in enumerate(sides)] + up for i in range(len(pdf))]
        after = [[s[1][i // ARITY**k] for k, s in enumerate(sides)] + down for i in range(len(pdf))]
        return finish(pdf, before, after)

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / size))
    return dealt.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(run, kinds)


def fold(h: str, before: list[str], after: list[str]) -> str:
    for a, b in zip(before, after, strict=True):
        h = digest(a, h, b)
    return h


def _ways(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """The outer nodes of each superblock, which is the node of its number one level up."""

    def finish(pdf: pd.DataFrame, before: list, after: list) -> pd.DataFrame:
        return pd.DataFrame({"grp": pdf["grp"], "block": pdf["pos"], "subroot": pdf["subroot"], "before": before, "after": after})

    return _proved(nodes, outer, depth, f"grp string, block long, subroot string, {_PATH}", finish)


def _ladder(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The levels of superblocks over ``grp, pos, n, h``, up to one node for each group."""
    levels = [nodes]
    while levels[-1].where(f"n > {ARITY**depth}").limit(1).count():
        levels.append(saved(_blocks(levels[-1], depth)))
    return [*levels, saved(_blocks(levels[-1], depth))]


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str, claimed: str | None = None, depth: int = DEPTH) -> DataFrame:
    """``rows`` with their proofs in the tree over the digests ``leaf``, and whether the digest ``claimed`` fits in.

    Adds ``subroot, root, before, after`` (the proof: what stands before and after the
    node on the way, joined, level by level), ``proof_sha256, folded_root, verified``; without
    ``claimed``, the leaf itself is verified. Groups are told by the text ``group`` (null first,
    UTF-8 bytewise), rows in one by ``order``, nulls first, then by ``leaf``; rows that tie in
    all are alike and take consecutive places, any one each. An empty table gives none.
    Columns of ``rows`` with a name that is used here are refused by ``ValueError``.
    """
    added = ("subroot", "root", "before", "after", "proof_sha256", "folded_root", "verified", "grp", "pos", "n", "h", "block", "part", "place", "tie", "claim", "member")
    clash = {c.lower() for c in rows.columns} & set(added)
    if clash:
        raise ValueError(f"columns {sorted(clash)} have names of the result's or of this function's")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first
    leaves = saved(rows.withColumn("grp", key).withColumnRenamed(leaf, "h").withColumn("claim", F.col(claimed) if claimed else F.col("h")))
    leaves = saved(numbered(leaves, "grp", *order, "h"))
    ladder = _ladder(leaves.select("grp", "pos", "n", "h"), depth)
    subroots = ladder[-1].select(F.lit("").alias("all"), F.col("grp").alias("member"), "h")
    sources = saved(numbered(subroots, "all", "member").select(F.col("all").alias("grp"), "pos", "n", "h", "member"))
    above = _ladder(sources.select("grp", "pos", "n", "h"), depth)
    top = above[-1].select("h").first()
    none = F.array().cast("array<string>")
    outer = above[-1].select("grp", F.col("pos").alias("block"), F.lit("").alias("subroot"), none.alias("before"), none.alias("after"))
    for nodes in above[-2:0:-1]:
        outer = saved(_ways(nodes, outer, depth))
    # each source's way to the root, from its place among the sources to its name
    ways = _ways(sources.select("grp", "pos", "n", "h"), outer, depth).select(F.col("block").alias("pos"), "before", "after")
    outer = saved(sources.join(ways, "pos").select(F.col("member").alias("grp"), F.lit(0).cast("long").alias("block"), F.col("h").alias("subroot"), "before", "after"))
    for nodes in ladder[-2:0:-1]:
        outer = saved(_ways(nodes, outer, depth))

    def finish(pdf: pd.DataFrame, before: list, after: list) -> pd.DataFrame:
        joined = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(before, after, strict=True)]
        folded = [fold(h, x, y) for h, x, y in zip(pdf["claim"], before, after, strict=True)]
        return pdf.assign(before=before, after=after, proof_sha256=[digest(*x) for x in joined], folded_root=folded)

    kinds = ", ".join(f"`{c}` {t}" for c, t in leaves.dtypes)
    proved = _proved(leaves, outer, depth, f"{kinds}, block long, subroot string, {_PATH}, proof_sha256 string, folded_root string", finish)
    own = [F.col("h").alias(c) if c == leaf else F.col(f"`{c}`") for c in rows.columns]
    root = F.lit(top["h"] if top else None).cast("string")
    return proved.select(*own, "subroot", root.alias("root"), "before", "after", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, claimed``: a leaf for each document and the one that it would have with the text ``tampered``.

    Null fields are told from empty ones. Other columns, whatever their names, are ignored.
    """
    fields = [F.col(c) for c in FIELDS]
    claimed = leaf_digest(*(tampered if c == "text" and tampered is not None else F.col(c) for c in FIELDS))
    return docs.select("doc_id", "source", leaf_digest(*fields).alias("leaf"), claimed.alias("claimed"))
