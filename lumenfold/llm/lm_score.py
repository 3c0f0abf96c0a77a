"""Language-model scores by logistic context mixing.

A text is a sequence of units: bytes up to and including a white space, the last
one closed by an end mark. A unit is told as its shape (what surrounds its first run
of letters, and their case; given whether a sentence begins) and its core (those
letters, lowered). Each bit of the two strings is predicted in five hashed contexts
(none, one, two, three bytes of the string, its whole prefix); the predictions are
mixed in the logistic domain by weights that a gate picks (the kind of string and
how often the longest contexts were seen), learned online by gradient steps, and
refined by an adaptive table over gate and mixed probability. A core's probability is
refined once more by its own counts: discounted counts, and the bits' probability
for what the discount leaves; then the same within each group of training texts (a
language). A unit depends on itself, the sentence flag and the group alone, so each
distinct unit is scored once; a text's probability is the mixture over the groups and
the counts of all training texts; these stand for training texts of any further group or
of none, and are left out where there are no such texts.
Across words a match model predicts: where the hash of the last four units falls on a
fixed share of values, a passage begins, which ends at the next such place or with the
text. In the context of those units (or of a text's beginning) a passage has the
mixture of its count after the same context in the training texts and of its units'
probability; a gate on how often the context was seen picks the mixture's weight,
which is learned from the training passages, each left out of its own counts. One
model scores all rows: a training text meets its own passages in it, as any copy would.
The most frequent units, a fixed number, go to every block of texts; a block's other
units are joined to it. Counts cover all
training texts and grow with them; tables and weights have a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm._shared import ascii_lower, crc_mod, dropped, saved
from lumenfold.llm._words import _BYTE, _SPACE, _STEP, PIECE, U, chunks, mix, powers

#: bits of a slot number by context: none, one, two, three bytes, the whole prefix
ORDER_BITS = (16, 18, 19, 20, 21)
ORDERS, SLOTS, GATES, STEPS = len(ORDER_BITS), sum(1 << b for b in ORDER_BITS), 64, 33
_OFFSETS = [sum(1 << b for b in ORDER_BITS[:i]) for i in range(len(ORDER_BITS))]
#: a byte that no UTF-8 text holds closes a text
END, PART = b"\xff", 8192
#: bytes of text of a block
BLOCK = 20 << 20
#: the most frequent units, so many at most, are sent to every block; the others are joined
TOP = 1 << 18
#: what each seen core leaves to unseen ones; the first byte of a core's string; the marks of a core's case in a shape
DISCOUNT, CORE, CASES = 0.75, b"\x02", (b"\xf8", b"\xf9", b"\xfa", b"\xfb")
#: the most common values of the grouping column, so many at most, are groups of their own; the counts of all rows serve the others
GROUPS = 4
#: units of a passage's context, and units of a passage on average
LAST, PASSAGE = 4, 128
#: contexts with at least one in so many of all passages, at most so many contexts, are broadcast; the others are joined
HOT = 8192
_LETTERS, _BEGIN = re.compile(rb"[A-Za-z\x80-\xf7]+"), np.isin(np.arange(256), list(b".!?"))
_ENDS = _SPACE.copy()
_ENDS[END[0]] = True


def unit_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, start, end (exclusive) and sentence flag (does one begin?) of each unit of the texts, and their buffer."""
    raw = b"".join(t + END for t in texts)
    buffer = np.frombuffer(raw, np.uint8)
    stops = np.flatnonzero(_ENDS[buffer]) + 1
    starts = np.append(0, stops[:-1]) if len(stops) else stops
    power, back = powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * power[: len(buffer)], out=total[1:])
    last, before = (buffer[np.maximum(starts - k, 0)] for k in (1, 2))
    begins = (starts == 0) | (last == END[0]) | (last == 10) | _BEGIN[before]
    return mix((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64) + begins * U(1 << 40)), starts, stops, begins, raw


def text_of(sizes: list[int], stops: np.ndarray) -> np.ndarray:
    """The text of each unit: the one that ends at a text's end mark closes the text; a mark within a text only ends a unit."""
    return np.searchsorted(np.cumsum([n + 1 for n in sizes]), stops)


def passages(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The passage of each unit; and of each passage its context, a hash of context and units, and its text."""
    n = len(h)
    last = np.append(text[1:] != text[:-1], np.ones(min(n, 1), bool))
    rolled = np.zeros(n, np.uint64)
    for j in range(LAST):
        rolled[j:] += h[: max(n - j, 0)] * _STEP[j]
    rolled = mix(rolled)
    whole = np.zeros(n, bool)  # are the last units all of this text?
    whole[LAST - 1 :] = text[LAST - 1 :] == text[: max(n - LAST + 1, 0)]
    stops = np.flatnonzero(last | (whole & (rolled % U(PASSAGE) == 0))) + 1
    starts = np.append(0, stops[:-1]) if len(stops) else stops
    context = np.where((starts == 0) | last[starts - 1], U(0), rolled[starts - 1])
    power, back = powers(n + 1)
    total = np.append(U(0), np.cumsum(h * power[:n]))
    own = mix((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64) + context * _STEP[LAST])
    return np.repeat(np.arange(len(stops)), stops - starts), context, own, text[starts]


def matches(listed: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """What the training texts tell of each listed passage, and the weight of the match by binary digits of its context's count.

    ``listed`` has ``block, context, h, n``: ``n`` training sights, or 0 in a row for
    sights that teach nothing. Returns ``block, h, n, of``, with the counts of the
    passage and of its context, for contexts that training texts tell of.
    """
    each = listed.groupBy("context", "h").agg(F.sum("n").alias("n"))
    contexts = saved(each.groupBy("context").agg(F.sum("n").alias("of")).where("of > 0"))
    passages = contexts.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]
    hot = F.col("of") * HOT >= passages
    known = each.join(F.broadcast(contexts.where(hot).withColumnRenamed("of", "hot")), "context", "left")  # HOT rows at most
    rest = known.where("hot is null").drop("hot").join(contexts.where(~hot), "context").select("h", "n", "of")
    known = saved(known.where("hot is not null").select("h", "n", F.col("hot").alias("of")).unionByName(rest))
    digits = F.floor(F.log2(F.col("of") - 1.0)).cast("int").alias("digits")
    weights = np.zeros(64)
    for row in known.where("n > 0 and of > 1").groupBy(digits).agg(F.sum("n").alias("seen"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("met")).collect():  # 64 rows at most
        weights[row["digits"]] = (row["met"] + 0.5) / (row["seen"] + 1)
    return listed.select("block", "h").join(known, "h").select("block", "h", "n", "of"), weights


def shape(unit: bytes) -> bytes:
    """A unit with its flag in front, its first run of letters replaced by the mark of their case."""
    found = _LETTERS.search(unit, 1)
    if not found:
        return unit
    letters = found.group()
    capitals = sum(65 <= c <= 90 for c in letters)
    case = 0 if not capitals else 1 if capitals == 1 and 65 <= letters[0] <= 90 else 2 if letters.upper() == letters else 3
    return unit[: found.start()] + CASES[case] + unit[found.end() :]


def core(body: Column) -> Column:
    """The letters that a shape leaves out, lowered unless their case is mixed; empty without letters."""
    letters = F.regexp_extract(body, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", 0)
    return F.when(letters.rlike("^([A-Z]?[^A-Z]*|[^a-z]*)$"), ascii_lower(letters)).otherwise(letters)


def _bits(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots (order x bits), the bits, whether they are a core's, and the number of bits of each string but for its first byte, which is given."""
    sizes = np.array([len(u) for u in units])
    data = np.frombuffer(b"".join(units), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(data)) - np.repeat(starts, sizes)
    back = [np.where(at >= k, np.roll(data, k) + U(1), U(0)) for k in (1, 2, 3)]
    power, inverse = powers(int(sizes.max()) + 2)
    total = np.append(U(0), np.cumsum(_BYTE[data.astype(np.int64)] * power[at]))
    prefix = mix(total[:-1] - np.repeat(total[starts], sizes)) + at.astype(np.uint64)
    contexts = [np.zeros(len(data), np.uint64), back[0], back[0] + back[1] * U(257), back[0] + back[1] * U(257) + back[2] * U(66049), prefix]
    shift = np.arange(7, -1, -1, dtype=np.uint64)
    bits = (data[:, None] >> shift) & U(1)
    nodes = (data[:, None] | U(256)) >> (shift + U(1))
    slots = np.stack([(mix(c[:, None] * U(0x9E3779B97F4A7C15) + nodes * U(0xD6E8FEB86659FD93) + U(i)) >> U(64 - ORDER_BITS[i])).astype(np.int64).ravel() + _OFFSETS[i] for i, c in enumerate(contexts)])
    told = np.repeat(at > 0, 8)
    return slots[:, told], bits.ravel().astype(np.int8)[told], np.repeat(data[starts] == CORE[0], (sizes - 1) * 8), (sizes - 1) * 8


def _batches(batches: Iterator[pa.RecordBatch], most: int = 2_500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def _inputs(slots: np.ndarray, cores: np.ndarray, zeros: np.ndarray, ones: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions with a bias, and the gate, of each bit; ``without`` leaves one sight of that bit out."""
    n0, n1 = zeros[slots], ones[slots]
    if without is not None:
        n0, n1 = np.maximum(n0 - (without == 0), 0), np.maximum(n1 - (without == 1), 0)
    x = np.log((n1 + 0.4) / (n0 + 0.4))
    seen = np.log2(1 + n0[3:] + n1[3:])
    gate = np.minimum(seen[1].astype(np.int64), 7) * 4 + np.minimum((seen[0] / 3).astype(np.int64), 3) + 32 * cores
    return np.vstack([x, np.full((1, x.shape[1]), 0.3)]), gate


def _mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ji->i", weights[gate], x), -12, 12)


def _step(s: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((s + 12) * (STEPS - 1) / 24), 0, STEPS - 1).astype(np.int64)


def tables(units: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones of every slot from the strings ``unit, n``: sums within a task, then by table part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SLOTS))
        for batch in _batches(batches):
            slots, bits, _, sizes = _bits(batch.column("unit").to_pylist())
            n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), sizes).astype(float)
            side = bits * np.int64(SLOTS)  # zeros, then ones
            for row in slots:
                np.add.at(sums.reshape(-1), row + side, n)
        parts = sums.astype("<f4").reshape(2, -1, PART)
        used = np.flatnonzero(parts.any(axis=(0, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[:, i].tobytes() for i in used], pa.binary())], names=["part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [np.sum([np.frombuffer(b, "<f4").astype(float) for b in pdf["sums"]], axis=0).astype("<f4").tobytes()]})

    out = np.zeros((2, SLOTS // PART, PART), np.float32)
    for row in units.select("unit", "n").mapInArrow(count, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").collect():  # a fixed size
        out[:, row["part"]] = np.frombuffer(row["sums"], "<f4").reshape(2, PART)
    return out[0].ravel(), out[1].ravel()


def mixer(units: DataFrame, shared, rate: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and the refining table, learned online in each task and averaged, from ``unit, n``."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, ones = shared.value
        w, seen, total = np.full((GATES, ORDERS + 1), 0.3), np.zeros((2, GATES * STEPS)), 0.0
        for batch in _batches(batches, 2_000):
            slots, bits, cores, sizes = _bits(batch.column("unit").to_pylist())
            n = np.repeat(np.sqrt(batch.column("n").to_numpy(zero_copy_only=False).astype(float)), sizes)
            x, gate = _inputs(slots, cores, zeros, ones, bits)
            for i in range(0, len(bits), 4096):
                part = slice(i, i + 4096)
                s = _mixed(x[:, part], gate[part], w)
                error = (bits[part] - 1 / (1 + np.exp(-s))) * n[part]
                weight = np.bincount(gate[part], n[part], GATES)[:, None] + 1e-9
                step = np.stack([np.bincount(gate[part], error * v, GATES) for v in x[:, part]], axis=1) / weight
                w += rate * step * np.minimum(1, weight / 64)
                cell = gate[part] * STEPS + _step(s)
                seen += np.stack([np.bincount(cell, n[part] * (bits[part] == b), GATES * STEPS) for b in (0, 1)])
            total += float(n.sum())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([w.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["total", "w", "seen"])

    # the averages are sums by a fixed number of groups, so the driver gets a fixed size
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["total"].to_numpy()
        w = sum(np.frombuffer(b) * k for b, k in zip(pdf["w"], t, strict=True))
        return pd.DataFrame({"total": [t.sum()], "w": [(w / t.sum()).tobytes()], "seen": [sum(np.frombuffer(b) for b in pdf["seen"]).tobytes()]})

    kind = "total double, w binary, seen binary"
    parts = units.select("unit", "n").mapInArrow(learn, kind).withColumn("g", F.pmod(F.xxhash64("w"), F.lit(16))).groupBy("g").applyInPandas(lambda pdf: add(pdf), kind).collect()
    if not parts:
        return np.full((GATES, ORDERS + 1), 0.3), np.zeros((2, GATES * STEPS))
    w = np.average([np.frombuffer(p["w"]) for p in parts], axis=0, weights=[p["total"] for p in parts])
    return w.reshape(GATES, ORDERS + 1), sum(np.frombuffer(p["seen"]) for p in parts).reshape(2, -1)


def string_scores(strings: DataFrame, shared, model, shapes: bool = False) -> DataFrame:
    """Add ``lp``, the log10 probability of each string ``unit``, or of its shape."""
    kinds = ", ".join(f"{c} {t}" for c, t in strings.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, ones = shared.value
        w, seen = model.value
        for batch in _batches(batches):
            own = batch.column("unit").to_pylist()
            slots, bits, cores, sizes = _bits([shape(u) for u in own] if shapes else own)
            x, gate = _inputs(slots, cores, zeros, ones)
            s = _mixed(x, gate, w)
            p = 1 / (1 + np.exp(-s))
            cell = gate * STEPS + _step(s)
            p = (p + (seen[1][cell] + 4 * p) / (seen[0][cell] + seen[1][cell] + 4)) / 2
            lp = np.log10(np.where(bits == 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.add.reduceat(lp, np.cumsum(sizes) - sizes))], names=[*batch.schema.names, "lp"])

    return strings.mapInArrow(run, f"{kinds}, lp double")


def shape_counts(units: DataFrame) -> DataFrame:
    """``unit, n``: the shapes of ``unit, n``, with sums within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shape(u) for u in batch.column("unit").to_pylist()], pa.binary()), batch.column("n")], names=["unit", "n"])

    return units.select("unit", "n").mapInArrow(run, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_from(units: DataFrame, most: int = TOP) -> int:
    """The smallest count, in steps, that ``most`` units at most reach; a histogram of a fixed size tells it."""
    step = F.floor(F.log2(F.col("n") + F.lit(0.0)) * 16).cast("int")
    steps = units.where("n > 0").groupBy(step.alias("step")).agg(F.count("*").alias("units"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # 16 for each binary digit
    least, total = np.iinfo(np.int64).max, 0
    for row in steps:
        total += row["units"]
        if total > most:
            break
        least = row["least"]
    return int(least)


def score_documents(docs: DataFrame, train: str = "train", group: str = "lang") -> DataFrame:
    """Score all texts by what the rows with a true ``train`` teach.

    ``docs`` has ``doc_id, text``, the boolean ``train`` and, if it likes, ``lang``,
    which only sorts the training rows into groups and is no input of a score. Returns ``doc_id,
    n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``,
    one row per input row. A null text is empty: its one token is the end. Without training
    rows every token is unknown. Repeated rows are scored each on its own, and alike, as are a
    training row and a held-out copy of it; bytes that are not UTF-8 count as replacement characters in words; other columns are ignored;
    an empty table gives none.
    """
    kind = F.col(group) if group in docs.columns else F.lit(None).cast("string")
    # ids go through pandas as text, which keeps long ones and nulls as they are
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), kind.alias("kind"))
    common_kinds = rows.where("train and kind is not null").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(GROUPS).collect()
    number = F.lit(-1)
    for k, row in enumerate(common_kinds):
        number = F.when(F.col("kind") == row["kind"], k).otherwise(number)
    rows = rows.withColumn("g", F.coalesce(number, F.lit(-1))).drop("kind")
    groups, ends = range(len(common_kinds)), rows.where("train").count()
    others = ends - sum(r["count"] for r in common_kinds)
    parts = (*groups, "all") if others or not groups else tuple(groups)  # each part has training rows, if there are any
    in_part = np.array([r["count"] for r in common_kinds] + [others])[: len(parts)]
    shares = np.log10((in_part + 1) / (ends + len(parts)))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // BLOCK + 1)).cast("int"))
    doc_kind = dict(docs.dtypes)["doc_id"]

    def list_units(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, times, taught_by, places, buffers, seen = [], [], [], [], [], ([], [])
        side = pdf["g"].where(pdf["train"], -2)  # -2: teaches nothing, -1: is in no group
        for k in sorted(side.unique()):
            texts = pdf["text"][side == k].tolist()
            for a, b in chunks(texts):
                h, starts, stops, begins, raw = unit_hashes(texts[a:b])
                own, first, count = np.unique(h, return_index=True, return_counts=True)
                keys.append(own)
                times.append(count.astype(np.int32))
                taught_by.append(np.full(len(own), k, np.int8))
                places.append(np.stack([np.full(len(own), len(buffers)), starts[first], stops[first], begins[first]]))
                buffers.append(raw)
                _, context, passage, _ = passages(h, text_of([len(t) for t in texts[a:b]], stops))
                seen[int(k > -2)].append((context, passage))
        own, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        times, taught_by = np.concatenate(times), np.concatenate(taught_by)
        n = np.stack([np.bincount(which[taught_by == k], times[taught_by == k], len(own)).astype(np.int32) for k in (-1, *groups)])
        units = [bytes([flag]) + buffers[i][a:b] for i, a, b, flag in np.concatenate(places, axis=1)[:, first].T.tolist()]
        out = [pd.DataFrame({"h": own.view(np.int64), "unit": units, "context": 0, "n": n.sum(axis=0, dtype=np.int32)} | {f"g{k}": n[k + 1] for k in groups})]
        for taught, found in enumerate(seen):
            if found:
                context, passage = map(np.concatenate, zip(*found, strict=True))
                own, first, count = np.unique(passage, return_index=True, return_counts=True)
                out.append(pd.DataFrame({"h": own.view(np.int64), "unit": None, "context": context[first].view(np.int64), "n": (count * taught).astype(np.int32)} | {f"g{k}": np.int32(0) for k in groups}))
        return pd.concat(out, ignore_index=True).assign(block=pdf["block"].iloc[0])

    # units, and passages with a null in place of the unit
    both = saved(rows.groupBy("block").applyInPandas(list_units, "block int, h long, unit binary, context long, n int" + "".join(f", g{k} int" for k in groups)), "zstd")
    told, match_weights = matches(both.where("unit is null").select("block", "context", "h", "n"))
    listed = both.where("unit is not null").drop("context")
    by_group = [F.sum(f"g{k}").alias(f"g{k}") for k in groups]
    units = listed.groupBy("h").agg(F.first("unit").alias("unit"), F.sum("n").alias("n"), *by_group)
    body = F.make_valid_utf8(F.substring("unit", 2, F.octet_length("unit") - 2).cast("string"))
    by_word = W.partitionBy("word")  # the spellings of one word, which goes by its hash
    units = units.withColumn("word", F.xxhash64(ascii_lower(body))).withColumn("c", F.sum("n").over(by_word)).withColumn("lead", F.min("h").over(by_word) == F.col("h"))
    written = saved(units.select("h", "unit", "n", *(f"g{k}" for k in groups), "lead", F.when(F.octet_length("unit") == 2, -1).otherwise(F.col("c")).alias("c")), "zstd")
    units = written.withColumn("core", core(body))  # the core isn't written: it follows from the unit
    known, tokens = units.where("lead and c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_all, vocabulary = tokens + ends, known + (ends > 0)
    context = docs.sparkSession.sparkContext
    strings = F.concat(F.lit(CORE), F.encode("core", "UTF-8"), F.lit(END)).alias("unit")
    cores = units.where("core <> ''").groupBy("core").agg(F.sum("n").alias("n"), *by_group).select("core", "n", *(f"g{k}" for k in groups), strings)
    cores = written_cores = saved(cores)
    facts = cores.agg(*(x for c in ("n", *(f"g{k}" for k in groups)) for x in (F.count_if(F.col(c) > 0).alias(f"{c}_kinds"), F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_seen")))).first()
    shapes = saved(shape_counts(units.where("n > 0")))
    taught = shapes.unionByName(cores.where("n > 0").select("unit", F.lit(1).cast("long").alias("n")))
    shared = context.broadcast(tables(taught))  # 2 x SLOTS numbers
    model = context.broadcast(mixer(taught, shared))
    by_bits = F.pow(F.lit(10.0), F.greatest("lp", F.lit(-250.0)))
    refined = lambda c, below: (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * facts[f"{c}_kinds"] * below) / facts[f"{c}_seen"] if facts[f"{c}_seen"] else below
    cores = string_scores(cores.select("core", "n", *(f"g{k}" for k in groups), "unit"), shared, model).withColumn("p", refined("n", by_bits))
    refined_by = {k: refined(f"g{k}", F.col("p")) for k in groups} | {"all": F.col("p")}
    cores = cores.select("core", *(F.when(F.col("lp") > -250, F.log10(p)).otherwise(F.col("lp")).alias(f"core{k}") for k, p in refined_by.items() if k in parts))
    often = frequent_from(units)
    scored = string_scores(units.select("h", "unit", "n", "c", "core"), shared, model, shapes=True).join(cores, "core", "left")
    scored = saved(scored.select("h", "n", "c", *((F.col("lp") + F.coalesce(f"core{k}", F.lit(0.0))).cast("float").alias(f"lp{k}") for k in parts)))
    dropped(written, written_cores, shapes)  # what follows reads the scores
    shared.destroy()
    model.destroy()
    frequent = F.broadcast(scored.where(F.col("n") >= often).select("h"))  # TOP rows at most
    top = scored.where(F.col("n") >= often).drop("n").toArrow().sort_by("h")  # TOP rows at most
    scored = scored.where(F.col("n") < often).drop("n")
    columns = ("h", "c", *(f"lp{k}" for k in parts))
    common = context.broadcast(tuple(top[k].to_numpy() for k in columns))
    rare = listed.select("block", "h").join(frequent, "h", "left_anti")
    # rows of passages have -2 - their count in place of a word's, which is -1 or more, and their context's count in place of the scores
    counts = (F.col("of").cast("float").alias(f"lp{k}") for k in parts)
    looked_up = rare.join(scored, "h").unionByName(told.select("block", "h", (-2 - F.col("n")).alias("c"), *counts))

    def score_block(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        match = np.flatnonzero(found["c"].to_numpy(np.int64) < -1)
        match = match[np.argsort(found["h"].to_numpy(np.int64)[match])]
        matched, sights, of = (np.append(found[k].to_numpy(np.int64)[match], 0) for k in columns[:3])
        unit = np.append(np.ones(len(common.value[0]), bool), found["c"].to_numpy(np.int64) >= -1)
        order = np.argsort(np.append(common.value[0], found["h"].to_numpy(np.int64)))
        order = order[unit[order]]
        keys, c, *lps = (np.append(mine, found[k].to_numpy(mine.dtype))[order] for mine, k in zip(common.value, columns, strict=True))
        base = np.log10((np.maximum(c, 0) + 1) / (n_all + vocabulary + 1))
        base[c < 0] = 0.0
        own, out = texts["text"].tolist(), []
        for a, b in chunks(own, PIECE):
            h, starts, stops, *_ = unit_hashes(own[a:b])
            at = np.searchsorted(keys, h.view(np.int64))
            doc = text_of([len(t) for t in own[a:b]], stops)
            total = lambda v, doc=doc, n=b - a: np.bincount(doc, v, n)
            passage, _, key, where = passages(h, doc)
            place = np.searchsorted(matched[:-1], key.view(np.int64))
            told = matched[place] == key.view(np.int64)
            n, n_context = (np.where(told, v[place], 0) for v in (-2 - sights, of))
            weight = np.where(n_context > 0, match_weights[np.log2(np.maximum(n_context, 1)).astype(np.int64)], 0.0)
            with np.errstate(divide="ignore"):
                by_match, by_units = np.log(weight * n / np.maximum(n_context, 1)), np.log(1 - weight)
            total_of = lambda lp, passage=passage, where=where, by_match=by_match, by_units=by_units, n=b - a: np.bincount(where, np.logaddexp(by_match, by_units + np.bincount(passage, lp) * np.log(10)) / np.log(10), n)
            out.append(np.stack([total(c[at] >= 0) + 1, total(c[at] > 0) + (ends > 0), total(base[at]) + np.log10((ends + 1) / (n_all + vocabulary + 1)), *(total_of(lp[at]) for lp in lps)]))
        m = np.concatenate(out, axis=1) if out else np.zeros((3 + len(lps), 0))
        each = m[3:] + shares[:, None]  # the mixture over the groups and all rows
        top = each.max(axis=0)
        score = top + np.log10((10 ** (each - top)).sum(axis=0))
        return pd.DataFrame({"doc_id": texts["doc_id"].to_numpy(), "n_tokens": m[0].astype(np.int64), "n_known": m[1].astype(np.int64), "base_score": m[2], "score": score, "n_bytes": [len(t) for t in own]})

    groups = rows.select("doc_id", "text", "block").groupBy("block").cogroup(looked_up.groupBy("block"))
    out = groups.applyInPandas(score_block, "doc_id string, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.lit(1), F.col("n_bytes"))
    return out.withColumn("doc_id", F.col("doc_id").cast(doc_kind)).withColumn("train_tokens", F.lit(n_all).cast("long")).withColumn("bits_per_byte", bits)


def held_out(modulus: int = 7, rest: int = 2):
    return F.coalesce(crc_mod("doc_id", modulus) == rest, F.lit(False))
