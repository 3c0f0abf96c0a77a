"""Near-duplicate embeddings by product quantisation.

Equal vectors are one class. A bounded sample fits coarse centroids and the
codebooks of the residuals' subspaces; every class is put into the inverted list
of its nearest centroid. A vector probes all lists whose cell its ball of the
radius can meet (by planes between a centroid and the mean of the nearest ones).
Codes of eight bytes go to the probed lists first: table lookups with a margin of
the code's own error tell which vectors have any candidate there. Only those travel
as whole vectors, each to the lists of its candidates, where pairs are reranked by
exact cosine; so no link is lost. Of two lists, the later sends its codes and keeps
its vectors. Queries and members of a list meet in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm._shared import connected_components, saved

#: the bound of the fitted sample; centroids at most; subspaces (their codes fill a long) and codes of each
SAMPLE, LISTS, PARTS, CODES = 16384, 4096, 8, 64
#: rows of a block of vectors, and of one of codes; broadcast cells at most; pairs looked at together
BLOCK, CODE_BLOCK, CELLS, PAIRS = 2048, 32768, 1 << 18, 1 << 20
THRESHOLD = 0.98


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres**2).sum(1) - 2 * x[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(x), 1024)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def fit(units: np.ndarray, lists: int) -> dict:
    coarse = kmeans(units, min(lists, len(units)))
    rest = units - coarse[_nearest(units, coarse)]
    split = np.array_split(np.arange(units.shape[1]), min(PARTS, units.shape[1]))
    books = [kmeans(rest[:, s], min(CODES, len(rest)), 5) for s in split]
    # what a member's list and codes add to its squared distance from any query
    plus = [2 * coarse[:, s] @ b.T + (b**2).sum(1) for s, b in zip(split, books, strict=True)]
    return {"coarse": coarse, "split": split, "books": books, "plus": plus}


def _reach(p: np.ndarray, score: np.ndarray, coarse: np.ndarray, radius: float) -> np.ndarray:
    """Lists that may hold a vector within the radius of each row of ``p``.

    A vector of a list scores its own centroid above the mean of any others, and
    moving by the radius changes that margin by radius x their distance at most.
    """
    best = np.argsort(-score, axis=1)[:, :4]
    out = np.ones(score.shape, bool)
    for k in (1, 2, 4):
        own = best[:, :k]
        mean, margin = coarse[own].mean(axis=1), np.take_along_axis(score, own, 1).mean(axis=1)
        gap = np.sqrt(np.maximum(0, (mean**2).sum(1)[:, None] + (coarse**2).sum(1) - 2 * mean @ coarse.T))
        out &= margin[:, None] - score <= radius * gap + 1e-9
    return out


def _project(units: np.ndarray, width: int) -> np.ndarray:
    """Cut or pad to ``width``: distances don't grow, so bounds stay bounds."""
    return units[:, :width] if units.shape[1] >= width else np.pad(units, ((0, 0), (0, width - units.shape[1])))


def _units(raw: pd.Series) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f8") for b in raw])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _lookup(q: np.ndarray, queries: pd.DataFrame, members: pd.DataFrame, model: dict, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, member) that table lookups leave, each pair of vectors once, in bounded pieces."""
    coarse = model["coarse"]
    p = _project(q, coarse.shape[1])
    used, own = np.unique(members["own"].to_numpy(), return_inverse=True)
    codes = members["codes"].to_numpy("<i8").view(np.uint8).reshape(-1, 8)
    plus = sum(t[used[own], codes[:, j]] for j, t in enumerate(model["plus"]))
    limit = (radius + members["err"].to_numpy(float)) ** 2 + 1e-9
    far0 = (p**2).sum(1)[:, None] + (coarse[used] ** 2).sum(1) - 2 * p @ coarse[used].T
    tables = [-2 * p[:, s] @ b.T for s, b in zip(model["split"], model["books"], strict=True)]
    reach = np.stack([np.isin(used, x) for x in queries["probes"]])
    mine, lists, ids, others = queries["own"].to_numpy(), used[own], queries["cls"].to_numpy(), members["cls"].to_numpy()
    step = max(1, PAIRS // len(members))
    for i in range(0, len(q), step):
        part = slice(i, i + step)
        far = far0[part][:, own] + plus
        for j, t in enumerate(tables):
            far += np.take(t[part], codes[:, j], axis=1)
        once = (mine[part, None] < lists) | ((mine[part, None] == lists) & (ids[part, None] < others))
        qi, mi = np.nonzero((far <= limit) & once & reach[part][:, own])
        yield qi + i, mi


def _candidates(queries: pd.DataFrame, members: pd.DataFrame, model: dict, radius: float) -> pd.DataFrame:
    """The lists where each query has a candidate (``asks``), and the members that are one."""
    asks, told = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    if len(queries) and len(members):
        ids, others, lists = queries["cls"].to_numpy(), members["cls"].to_numpy(), members["own"].to_numpy(np.int64)
        for qi, mi in _lookup(_units(queries["raw"]), queries, members, model, radius):
            one = np.unique(qi * (1 << 32) + lists[mi])
            asks.append(np.stack([ids[one >> 32], one & 0xFFFFFFFF], axis=1))
            one = np.unique(mi)
            told.append(np.stack([others[one], lists[one]], axis=1))
    asks, told = np.concatenate(asks), np.unique(np.concatenate(told), axis=0)
    both = np.concatenate([asks, told])
    return pd.DataFrame({"cls": both[:, 0], "list": both[:, 1].astype(np.int32), "asks": np.arange(len(both)) < len(asks)})


def _join(queries: pd.DataFrame, members: pd.DataFrame, model: dict, threshold: float, radius: float) -> pd.DataFrame:
    """Links between queries and members of one list: for each node its component's smallest node and the copies linked."""
    none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "add": pd.Series(dtype="int64")})
    if not len(queries) or not len(members):
        return none
    q, m = _units(queries["raw"]), _units(members["raw"])
    ids = np.concatenate([queries["cls"].to_numpy(), members["cls"].to_numpy()])
    copies = np.concatenate([queries["copies"].to_numpy(), members["copies"].to_numpy()])
    add, left, right = np.zeros(len(ids)), [], []
    for qi, mi in _lookup(q, queries, members, model, radius):
        keep = np.concatenate([np.einsum("ij,ij->i", q[qi[i : i + 65536]], m[mi[i : i + 65536]]) >= threshold for i in range(0, len(qi), 65536)] or [np.zeros(0, bool)])
        qi, mi = qi[keep].astype(np.int32), (mi[keep] + len(q)).astype(np.int32)
        add += np.bincount(qi, copies[mi], len(ids)) + np.bincount(mi, copies[qi], len(ids))
        left.append(qi)
        right.append(mi)
    left, right, low = np.concatenate(left), np.concatenate(right), ids.copy()
    while True:  # the smallest id reaches its component
        before = low.copy()
        np.minimum.at(low, left, low[right])
        np.minimum.at(low, right, low[left])
        if (low == before).all():
            break
    some = add > 0
    return pd.DataFrame({"a": ids[some], "b": low[some], "add": add[some].astype(np.int64)})


def _dealt(queries: DataFrame, members: DataFrame, rows: int):
    """Both sides grouped by label, length, list and block: ``BLOCK`` queries meet ``rows`` members at a time."""
    key = ["label", "dim", "list"]
    count = lambda df, n, name: df.groupBy(*key).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    blocks = saved(count(members, rows, "nm").join(count(queries, BLOCK, "nq"), key))
    if blocks.count() <= CELLS:
        blocks = F.broadcast(blocks)
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = members.join(blocks, key).withColumn("mb", block("nm")).withColumn("qb", each("nq")).drop("nm", "nq")
    queries = queries.join(blocks, key).withColumn("qb", block("nq")).withColumn("mb", each("nm")).drop("nm", "nq")
    group = [*key, "mb", "qb"]
    return queries.toDF(*queries.columns).groupBy(*group).cogroup(members.toDF(*members.columns).groupBy(*group))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row of ``vec_id, embedding, label``.

    Links are pairs of one label whose cosine is ``threshold`` or more; only
    vectors of one length are compared. Null, empty or zero vectors, such with a
    null or non-finite part, and rows with a null label or id link with nothing;
    a null id has a null component and stays. Repeated rows are vectors of their
    own. Other columns are ignored; an empty table gives none.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), "label")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = saved(rows.withColumn("ok", F.coalesce(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))).withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(1), "v", "label")}))
    classes = saved(rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label")))
    n = classes.count()
    picked = classes if n <= sample else classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    fitted = [np.array(r["v"]) for r in picked.select("v").limit(2 * sample).collect()]  # bounded by ``sample``
    if not fitted:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(map(len, fitted))
    model = fit(_project_all(fitted, width), max(1, min(LISTS, math.isqrt(n))))
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # LISTS x width and PARTS x CODES numbers

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        coarse = own["coarse"]
        for pdf in (whole.iloc[i : i + 1024] for whole in frames for i in range(0, len(whole), 1024)):
            raw = [np.asarray(v, "<f8") for v in pdf["v"]]
            p = _project_all(raw, width)
            score = p @ coarse.T - (coarse**2).sum(1) / 2
            near = np.argmax(score, axis=1)
            rest = p - coarse[near]
            codes = np.zeros((len(p), 8), np.uint8)
            for j, (s, b) in enumerate(zip(own["split"], own["books"], strict=True)):
                codes[:, j] = np.argmin((b**2).sum(1) - 2 * rest[:, s] @ b.T, axis=1)
            back = np.concatenate([b[codes[:, j]] for j, b in enumerate(own["books"])], axis=1)
            err = np.nextafter(np.sqrt(((rest - back) ** 2).sum(1)).astype(np.float32), np.float32(np.inf))
            probes = [np.flatnonzero(r).astype(np.int32) for r in _reach(p, score, coarse, radius)]
            yield pd.DataFrame({"cls": pdf["cls"].to_numpy(), "copies": pdf["copies"].to_numpy(), "label": pdf["label"].to_numpy(), "dim": [len(v) for v in raw], "raw": [v.tobytes() for v in raw], "own": near.astype(np.int32), "codes": codes.view("<i8").ravel(), "err": err, "probes": probes})

    label = dict(classes.dtypes)["label"]
    placed = saved(classes.select("cls", "copies", "v", "label").mapInPandas(assign, f"cls long, copies long, label {label}, dim int, raw binary, own int, codes long, err float, probes array<int>"))
    queries = placed.select("cls", "label", "dim", "raw", "own", "probes", F.col("own").alias("list"))
    sent = placed.select("cls", "label", "dim", "own", "codes", "err", F.explode(F.filter("probes", lambda x: x <= F.col("own"))).alias("list"))
    kept = saved(_dealt(queries, sent, CODE_BLOCK).applyInPandas(lambda q, m: _candidates(q, m, shared.value, radius), "cls long, list int, asks boolean").distinct())
    queries = placed.join(kept.where("asks").select("cls", "list"), "cls").drop("codes", "err")
    members = placed.join(kept.where("not asks").select("cls").distinct(), "cls", "left_semi").withColumn("list", F.col("own")).drop("probes")
    links = saved(_dealt(queries, members, BLOCK).applyInPandas(lambda q, m: _join(q, m, shared.value, threshold, radius), "a long, b long, add long"))
    roots = connected_components(links.select("a", "b"))
    sums = links.groupBy("a").agg(F.sum("add").alias("linked"))
    found = classes.select("k1", "k2", "cls", "copies").join(sums, F.col("cls") == F.col("a"), "left").join(roots, F.col("cls") == F.col("node"), "left")
    found = found.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("component_id"))
    out = rows.where("ok").join(found, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _project_all(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        v = v / math.sqrt(float(v @ v))
        out[i, : min(width, len(v))] = v[:width]
    return out
