"""Near-duplicate documents by one-permutation MinHash.

Each distinct set of word shingles becomes a node, named by its smallest doc_id.
One permutation hash with optimal densification (Shrivastava, 2017) gives 128
values; 32 bands of four values are the bucket keys. Inside a bucket every node
is compared with one hub only (a star), so the pairs grow with the rows. What a
star can miss is made good by further rounds over the buckets that still hold
several components: stars around another hub, and at last all pairs of a bucket
that are still in different components, unless sizes or parity bits prove a pair
too far apart. So any two nodes that share a bucket end in one component or have
been compared. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm._shared import saved, sent, stars
from lumenfold.llm._words import U, mix, pieces, shingle_sets

BINS, BANDS, PARITY = 128, 32, 512
#: rounds of stars around a new hub; nodes of a bucket that one task of the last round gets
REHUBS, BLOCK = 2, 1024
#: for an empty bin, the bins to borrow from, in this order (the same for every document)
_DONORS = np.random.default_rng(3).integers(0, BINS, (BINS, 64 * BINS), dtype=np.int16)
_ROWS = np.random.default_rng(5).integers(1, 1 << 63, BINS, dtype=np.uint64) * U(2) + U(1)


def band_hashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The band keys, a row for each non-empty set; ``values`` holds the sets' sorted values one after the other."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = owner * BINS + (values >> U(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    table, filled = np.zeros(len(sizes) * BINS, np.uint64), np.zeros(len(sizes) * BINS, bool)
    table[cell[first]], filled[cell[first]] = values[first], True
    empty, at, step = np.flatnonzero(~filled), 0, 1
    while len(empty) and at < _DONORS.shape[1]:  # a few donors at a time, until all have one
        own = _DONORS[empty % BINS, at : at + step] + (empty - empty % BINS)[:, None]
        got = filled[own]
        found = got.any(axis=1)
        donor = own[found, got[found].argmax(axis=1)]
        table[empty[found]] = table[donor]
        empty, at, step = empty[~found], at + step, min(64, step * 2)
    rows = (table.reshape(-1, BINS) * _ROWS).reshape(len(sizes), BANDS, BINS // BANDS).sum(axis=2, dtype=np.uint64)
    return mix(rows + np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def parity(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of values in each of ``PARITY`` bins, as bits. Two sets differ in at least as many values as bits."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(owner * PARITY + (values & U(PARITY - 1)).astype(np.int64), minlength=len(sizes) * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), PARITY // 64)


def set_keys(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """128 bits that stand for each non-empty set."""
    if not len(sizes):
        return []
    at = np.cumsum(sizes) - sizes
    a = np.add.reduceat(mix(values + U(1)), at)
    b = np.add.reduceat(mix(values ^ U(0xA5A5A5A5A5A5A5A5)), at) + sizes.astype(np.uint64)
    raw = np.stack([a, b], axis=1).astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _lists(rows: np.ndarray) -> pa.Array:
    flat = rows.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def features(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles`` of each row, and ``set binary, bands array<bigint>, parity array<bigint>``, null or zeros without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            values, counts = shingle_sets(texts, width)
            some = counts > 0
            bands, bits = np.zeros((len(texts), BANDS), np.uint64), np.zeros((len(texts), PARITY // 64), np.int64)
            bands[some], bits[some] = band_hashes(values, counts[some]), parity(values, counts[some])
            keys = np.full(len(texts), None, object)
            keys[some] = set_keys(values, counts[some])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), _lists(bands), _lists(bits)], names=["doc_id", "n_shingles", "set", "bands", "parity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set binary, bands array<long>, parity array<long>")


def node_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """``set, shingles array<bigint>`` of each document that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            values, counts = shingle_sets(texts, width)
            counts = counts[counts > 0]
            shingles = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, counts), pa.binary()), shingles], names=["set", "shingles"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "set binary, shingles array<long>")


def _relabelled(rows: DataFrame, merged: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` with ``root`` replaced by what it became a part of."""
    into, many = merged
    into = sent(into.select(F.col("node").alias("root"), F.col("root").alias("into")), many)
    return rows.join(into, "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into")


def _unsettled(rooted: DataFrame) -> DataFrame:
    """The rows whose bucket holds several components by ``root``, with the largest one, ``main``."""
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("part"))
    cells = parts.groupBy("key").agg(F.max(F.struct("part", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.sum("part").alias("members")).where("roots > 1")
    return rooted.join(cells.drop("roots"), "key")


def _apart(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` (a < b) of nodes that share an unsettled bucket and are in different components, ``x`` and ``y``, each once.

    A bucket's largest component is met by the nodes outside it only. The bucket is
    dealt into blocks of about ``BLOCK`` nodes, each of which meets all of those. Pairs
    whose sizes or parities show that they are under ``percent`` are left out; a pair
    belongs to the first band that it shares.
    """
    rest = saved(rest.join(nodes.select("node", "n", "bands", "parity"), ["node", "n"]).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    named = lambda p: [F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "root", "bands", "parity"))]
    all_ = rest.select("key", "band", block, *named("p"), (F.col("root") == F.col("main")).alias("p_main"))
    outside = rest.where("root <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *named("q"))
    fits = f"100 * least(p_n, q_n) >= {percent} * greatest(p_n, q_n)"
    differ = " + ".join(f"bit_count(p_parity[{i}] ^ q_parity[{i}])" for i in range(PARITY // 64))
    fits += f" and {100 + percent} * ({differ}) <= {100 - percent} * (p_n + q_n)"
    once = "array_position(zip_with(p_bands, q_bands, (x, y) -> x = y), true) = band + 1"
    pairs = all_.alias("l").join(outside.alias("r"), F.expr(f"l.key = r.key and l.block = r.block and p_root <> q_root and (p_main or p < q) and {fits} and {once}"))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.col("p_root").alias("x"), F.col("q_root").alias("y"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id, kept``, one row for each input
    row. A text that is null or has no words has no shingles and is linked with
    nothing. A row with a null ``doc_id`` keeps its count, is linked with nothing,
    has a null component and stays (``kept`` true). Rows that repeat a ``doc_id``
    are one document, linked by any of its texts that has words, and have the same
    ``kept``. An empty table gives none. Other columns are ignored. Bytes that are
    not UTF-8 are hashed as they are.
    """
    feats = saved(features(docs, width))
    named = feats.where("doc_id is not null and set is not null")
    nodes = saved(named.groupBy("set").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity")))
    buckets = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    fits = f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)"  # else even one set inside the other is too small
    hubs = buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1").drop("many")
    shared = saved(buckets.join(hubs, "key"))
    star = lambda rows, *more: rows.where(f"node <> hub.node and {fits}").select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"), *more).dropDuplicates(["a", "b"])
    # any node that shares a bucket may be needed
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("set", "node")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = saved(node_sets(texts, width).join(wanted, "set").dropDuplicates(["set"]).select("node", "shingles"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("q")), "b")
        return (
            left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("p")), "a")
            .select(*pairs.columns, (F.size("p") + F.size("q")).alias("total"), F.size(F.array_intersect("p", "q")).alias("common"))
            .where(f"100 * common >= {percent} * (total - common)")
            .select(*pairs.columns)
        )

    tested = saved(star(shared))
    links = confirmed(tested)
    # the texts of a doc_id that is repeated with other words are one document
    repeated = saved(named.groupBy("doc_id").agg(F.count("*").alias("many")).where("many > 1").select("doc_id"))
    if not repeated.isEmpty():
        own = named.select("doc_id", "set").join(repeated, "doc_id", "left_semi").join(nodes.select("set", "node"), "set").select("doc_id", "node").distinct()
        same = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last"), "doc_id").where("node <> a")
        links = links.union(same.select("a", F.col("node").alias("b")))
    # what joined what: nodes by the links of the first stars, then whole components by one link each or a few
    merged = [stars(links)]
    rooted = _relabelled(shared.drop("hub").withColumn("root", F.col("node")), merged[0])
    rows = shared.count()
    for turn in range(REHUBS + 1):
        # settled buckets stay settled
        shared = saved(_unsettled(rooted), rows=rows)
        rows = shared.count()
        if not rows:
            break
        if turn < REHUBS:
            others = shared.where("root <> main").groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(turn))).alias("hub"))
            more = star(shared.join(sent(others, rows), "key").where("root <> hub.root"), F.col("hub.root").alias("x"), F.col("root").alias("y"))
        else:
            more = _apart(shared, nodes, percent)
        more = saved(more.join(tested, ["a", "b"], "left_anti"))
        rooted = shared.drop("main", "members")
        if more.isEmpty():
            continue
        found = stars(confirmed(more).select(F.col("x").alias("a"), F.col("y").alias("b")))
        tested = tested.union(more.select("a", "b"))
        if found[1]:
            merged.append(found)
            rooted = _relabelled(rooted, found)
    labels = nodes.select("set", F.col("node").alias("root"))
    for part in merged:
        labels = _relabelled(labels, part)
    labels = labels.select("set", F.col("root").alias("component_id"))
    out = feats.select("doc_id", "n_shingles", "set").join(labels, "set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
