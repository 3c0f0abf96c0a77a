"""A quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Follow-the-regularised-leader (McMahan et al., 2013) runs on shards of a bounded,
hash-picked sample of labelled rows. There are as many shards as the sample needs,
one for a small sample; between rounds the shards' states are averaged and handed
on (iterative parameter mixing). A score is one sparse dot product over the words
and word pairs of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenfold.llm._shared import crc_mod, saved
from lumenfold.llm._words import U, chunks, mix, pieces, word_hashes

#: the bound of the fitted sample (labelled rows), and of the model: slots; rows of a shard; rounds of mixing, passes of each
SAMPLE, SLOTS, SHARD, ROUNDS, PASSES = 16_000, 1 << 18, 2_000, 2, 3
THRESHOLD = 0.3
_PAIR = U(0x9E3779B97F4A7C15)


def slots(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the slots of its word n-grams (1 and 2, plus one of repetition) and their values, of unit length."""
    hashes, counts = word_hashes(texts)
    pairs = mix(hashes[:-1] * _PAIR + hashes[1:])
    at = 0
    for n in counts.tolist():
        own = np.concatenate([hashes[at : at + n], pairs[at : at + max(0, n - 1)]])
        at += n
        index, times = np.unique(own >> U(46), return_counts=True)
        value = np.sqrt(times)
        norm = np.sqrt(times.sum()) if n else 1.0
        # what share of the words repeat the word before: a pair of one word with itself
        twice = float((own[1:n] == own[: n - 1]).mean()) if n > 1 else 0.0
        yield np.append(index.astype(np.int64), [SLOTS, SLOTS + 1]), np.append(value / norm, [twice, 1.0])


class Ftrl:
    """The state of FTRL-proximal: gradient sums ``z`` and squared sums ``n`` by slot."""

    def __init__(self, state: np.ndarray | None = None, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros((2, SLOTS + 2)) if state is None else state.astype(float)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], weigh: tuple[float, float], turns: range) -> None:
        for turn in turns:
            for k in np.random.default_rng(turn).permutation(len(rows)):
                i, x = rows[k]
                w = self.weights(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x * weigh[labels[k]]
                more = self.n[i] + g * g
                self.z[i] += g - (np.sqrt(more) - np.sqrt(self.n[i])) / self.alpha * w
                self.n[i] = more


def _learner(start, weigh: tuple[float, float], turns: range):
    """A round on one shard: from the shared state on, all passes over the shard's rows in one order."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        texts = pdf["text"].tolist()
        model = Ftrl(start.value)
        model.learn([x for a, b in chunks(texts) for x in slots(texts[a:b])], pdf["label"].tolist(), weigh, turns)
        return pd.DataFrame({"size": [len(texts)], "state": [np.stack([model.z, model.n]).astype("<f4").tobytes()]})

    return shard


def train(labelled: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from ``doc_id, text, label`` (labels other than 0 and 1 ignored).

    At most about ``sample`` rows, picked by a hash of doc_id and text, are learned
    from; both labels weigh the same in all, so that rare ones aren't drowned.
    Without labelled rows all weights are 0. Repeated rows count as often as they
    stand there; row order and partitioning don't matter.
    """
    rows = labelled.where("label in (0, 1)").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.col("label").cast("int").alias("label"))
    known = rows.count()
    if not known:
        return np.zeros(SLOTS + 2)
    if known > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 20)) < int(sample / known * (1 << 20)))
    shards = max(1, -(-min(known, sample) // SHARD))
    rows = saved(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.lit("shard")), F.lit(shards))))
    taken, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    weigh = (taken / (2 * max(1, taken - ones)), taken / (2 * max(1, ones)))
    context, state = labelled.sparkSession.sparkContext, None
    for turn in range(ROUNDS):
        start = context.broadcast(state)  # 2 x SLOTS numbers, always
        parts = rows.groupBy("shard").applyInPandas(_learner(start, weigh, range(turn * PASSES, (turn + 1) * PASSES)), "size long, state binary").collect()  # sample / SHARD arrays of 2 x SLOTS numbers
        parts = sorted(parts, key=lambda p: (p["size"], bytes(p["state"])))  # one order, so that reruns agree
        state = np.average([np.frombuffer(p["state"], "<f4").reshape(2, -1) for p in parts], axis=0, weights=[p["size"] for p in parts])
    return Ftrl(state).weights()


def score(docs: DataFrame, weights: np.ndarray, columns: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and, as ``name``, the probability of label 1 for each row.

    A null or empty text has only the bias; with no weights every score is 0.5.
    Bytes that are not UTF-8 are hashed as they are. Other columns are ignored;
    an empty table gives none. ``name`` must not be one of ``columns``.
    """
    if name.lower() in (c.lower() for c in columns):
        raise ValueError(f"{name!r} is a column already")
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # SLOTS + 2 numbers, always
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*columns, text])))
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part, texts in pieces(batches, at):
            sums = np.array([float(w[i] @ x) for i, x in slots(texts)])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())], names=[*columns, name])

    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in columns), StructField(name, DoubleType())])
    return rows.mapInArrow(run, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> DataFrame:
    """``doc_id, text, label`` of the labelled documents whose crc32(doc_id) mod ``held_out`` is not 0.

    A document with several labels has their largest; null labels, ids without a
    document and documents without a label are left out.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select("doc_id", "text").where(crc_mod("doc_id", held_out) != 0).join(known, "doc_id")
