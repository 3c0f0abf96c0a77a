"""Phrases whose words come together far more often than apart, by language.

Rabin-Karp fingerprints: within a task, prefix polynomials over the bytes give every
word a hash, and prefix polynomials over the words give every n-gram of a piece of
text a fingerprint, all in NumPy; a second polynomial of other numbers gives it a check.
Tasks count fingerprints, with a pointer to one occurrence, before the shuffle adds them
up. An n-gram can be frequent only if its parts are, so the rounds (words, pairs, three
and four words) count only what the frequent fingerprints of the round before leave; these are
told to the tasks by a bit table of a fixed size, whose errors let too much through, never too
little. The last round reads the texts once more: it compares the occurrences of what is
frequent word by word, and words byte by byte, so that a collision is found, and turns into text
only what a pointer names: each frequent phrase, once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm._shared import saved
from lumenfold.llm._words import _BYTE, _STEP, U, mix, pieces, powers, ranges

LONGEST, LEAST, TOP = 4, 30, 2000
#: bits of the table that tells frequent fingerprints: parts, bits of a part
PARTS, PART_BITS = 256, 1 << 20
#: bytes of text that are hashed at once; fingerprints that a task holds before it counts them
PIECE, HELD = 1 << 19, 1 << 20
#: groups of a language's phrases that are ranked on their own first
SALTS = 64
#: fixed values: what ends a piece, what else ends a word
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_ENDS_PIECE = np.isin(np.arange(256), list(BREAKS))
_ENDS_WORD = _ENDS_PIECE | np.isin(np.arange(256), list(BLANKS))
#: numbers of the second polynomial
_OTHER = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")


def _polynomial(values: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values`` times powers; those of a run follow from two of them."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(numbers * powers(len(values) + 1)[0][: len(values)], out=total[1:])
    return total


class Words:
    """The words of some texts: two hashes, place, piece, and the language's number and the row of the text."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, rows: np.ndarray) -> None:
        self.text = b"\n".join(texts).lower() + b"\n"
        buffer = np.frombuffer(self.text, np.uint8)
        ends = _ENDS_WORD[buffer]
        edge = np.flatnonzero(np.diff(ends.view(np.int8), prepend=np.int8(1)))
        self.starts, self.stops = edge[::2], edge[1::2]
        self.piece = np.cumsum(_ENDS_PIECE[buffer], dtype=np.int32)[self.starts]
        back, size = powers(len(buffer) + 1)[1][self.starts], (self.stops - self.starts).astype(np.uint64)
        self.hash, self.check = (mix((total[self.stops] - total[self.starts]) * back + size) for total in (_polynomial(buffer, numbers[buffer]) for numbers in (_BYTE, _OTHER)))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        of = np.searchsorted(begin[1:], self.starts, side="right")
        self.lang = langs[of] if len(texts) else np.zeros(0, np.int64)
        self.place = mix(rows[of] + (self.starts - begin[of]).astype(np.uint64) * U(0x9E3779B97F4A7C15)) if len(texts) else np.zeros(0, np.uint64)
        self.back = powers(len(self.hash) + 1)[1]
        self.totals = [_polynomial(h, h) for h in (self.hash, self.check)]

    def grams(self, n: int, salts: np.ndarray, which: int = 0) -> np.ndarray:
        """Fingerprints (or checks) of the runs of ``n`` words, one for each first word."""
        m = max(0, len(self.hash) - n + 1)
        total = self.totals[which]
        return mix((total[n : n + m] - total[:m]) * self.back[:m] + salts[self.lang[:m]] + U(n))

    def inside(self, n: int) -> np.ndarray:
        """Whether a run of ``n`` words stays in its piece."""
        m = max(0, len(self.hash) - n + 1)
        return self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def pointers(self, at: np.ndarray, n: int) -> np.ndarray:
        """A number for each occurrence of ``n`` words, the same whenever the text is read."""
        return mix(self.place[at] + U(n)).view(np.int64)


def _places(f: np.ndarray) -> tuple[np.ndarray, ...]:
    """Part of the bit table, and two bits of it, of each fingerprint."""
    return (f % U(PARTS)).astype(np.int64), ((f >> U(8)) % U(PART_BITS)).astype(np.int64), ((f >> U(36)) % U(PART_BITS)).astype(np.int64)


def bit_table(frequent: DataFrame) -> np.ndarray:
    """The bit table of the fingerprints ``f``: parts x bytes, a fixed size, which is all that the driver gets."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        part, *bits = _places(pdf["f"].to_numpy().view(np.uint64))
        own = np.zeros(PART_BITS, bool)
        for b in bits:
            own[b] = True
        return pd.DataFrame({"part": part[:1], "bits": [zlib.compress(np.packbits(own, bitorder="little").tobytes(), 1)]})

    table = np.zeros((PARTS, PART_BITS // 8), np.uint8)
    for row in frequent.select("f").groupBy(F.pmod("f", F.lit(PARTS))).applyInPandas(fill, "part long, bits binary").toLocalIterator():  # PARTS rows
        table[row["part"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return table


def listed(table: np.ndarray, f: np.ndarray) -> np.ndarray:
    part, *bits = _places(f)
    found = np.ones(len(f), bool)
    for b in bits:
        found &= (table[part, b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
    return found


def _cut(texts: list[bytes]) -> list[tuple[int, int, bytes]]:
    """The texts, long ones cut where a piece ends anyway: number of the text, start, part."""
    out = []
    for i, t in enumerate(texts):
        start = 0
        while len(t) - start > PIECE:
            end = max(t.rfind(bytes([b]), start, start + PIECE) for b in BREAKS)
            if end < 0:  # a piece of more than that
                later = _BREAK.search(t, start + PIECE)
                end = later.start() if later else len(t)
            out.append((i, start, t[start:end]))
            start = end + 1
        if start <= len(t):
            out.append((i, start, t[start:]))
    return out


def _read(batches: Iterator[pa.RecordBatch], langs: dict[str, int]) -> Iterator[Words]:
    """The words of the texts, in pieces of bounded size; ``langs`` gets a number for each new language."""
    for part, texts in pieces(batches, most=PIECE):
        own = np.array([langs.setdefault(x, len(langs)) for x in part.column("lang").to_pylist()], np.int64)
        rows = part.column("row").to_numpy(zero_copy_only=False).view(np.uint64)
        cut = _cut(texts)
        for a, b in ranges([len(t) for _, _, t in cut], PIECE):
            of = [i for i, _, _ in cut[a:b]]
            yield Words([t for _, _, t in cut[a:b]], own[of], rows[of] + np.array([k for _, k, _ in cut[a:b]], np.uint64) * _STEP[0])


def _salts(langs: dict[str, int]) -> np.ndarray:
    """A number for each language, the same in all tasks."""
    return np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _summed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Counts of fingerprints and checks, and the smallest pointer of each."""
    f, g, pointer = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(f, kind="stable")
    f, g, pointer = f[order], g[order], pointer[order]
    start = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (g[1:] != g[:-1]))[: len(f)])
    least = np.minimum.reduceat(pointer, start) if len(start) else pointer
    return pa.RecordBatch.from_arrays([pa.array(f[start].view(np.int64)), pa.array(g[start]), pa.nulls(len(start), pa.string()), pa.array(np.diff(np.append(start, len(f)))), pa.array(least)], names=_COUNTS)


_COUNTS = ["f", "g", "lang", "n", "pointer"]


def _counted(texts: DataFrame, orders: tuple[int, ...], below: int, shared) -> DataFrame:
    """Counts ``f, g, n`` of the fingerprints of the orders, of those whose parts of ``below`` words are all listed, and a pointer to one occurrence.

    With order 1, also rows without a fingerprint: all words of a language, ``lang, n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held, size, words = [], 0, Counter()
        for w in _read(batches, langs):
            salts = _salts(langs)
            if below:
                good = w.inside(below)
                good[good] = listed(shared.value, w.grams(below, salts)[good])
            else:
                words.update(dict(enumerate(np.bincount(w.lang, minlength=len(langs)).tolist())))
            for n in orders:
                keep = w.inside(n)
                for k in range(n - below + 1 if below else 0):
                    keep = keep & good[k : k + len(keep)]
                at = np.flatnonzero(keep)
                held.append((w.grams(n, salts)[at], (w.grams(n, salts, 1)[at] >> U(32)).astype(np.uint32).view(np.int32), w.pointers(at, n)))
                size += len(at)
            if size >= HELD:
                yield _summed(held)
                held, size = [], 0
        if held:
            yield _summed(held)
        if words:
            names, empty = list(langs), pa.nulls(len(words), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, pa.nulls(len(words), pa.int32()), pa.array([names[k] for k in words]), pa.array(list(words.values()), pa.int64()), empty], names=_COUNTS)

    return texts.mapInArrow(run, "f long, g int, lang string, n long, pointer long").groupBy("f", "g", "lang").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"))


def collided(w: Words, at: np.ndarray, f: np.ndarray, g: np.ndarray, n: int, ids: np.ndarray) -> bool:
    """Whether some of the occurrences ``at`` with one fingerprint and one check are different words or of different languages."""
    _, first, which = np.unique(f, return_index=True, return_inverse=True)
    mine = first[which]
    other = w.lang[at] != w.lang[at[mine]]
    for k in range(n):
        other |= ids[at + k] != ids[at[mine] + k]
    return bool((other & (g == g[mine])).any())


def word_ids(w: Words) -> tuple[np.ndarray, list[bytes]]:
    """A number for each distinct word, told by its bytes, and the words."""
    _, first, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    sizes, mine = w.stops - w.starts, first[ids]
    other = sizes != sizes[mine]
    wide = np.append(np.frombuffer(w.text, np.uint8), np.zeros(8, np.uint8))
    eight = np.ndarray(len(wide) - 7, "<u8", wide.data, strides=(1,))
    left = np.flatnonzero(~other)
    for k in range(0, int(sizes.max(initial=0)), 8):  # eight bytes at a time, of the words that have them
        left = left[sizes[left] > k]
        rest = np.minimum(sizes[left] - k, 8).astype(np.uint64)
        cut = (U(8) - rest) * U(8)
        other[left] |= (eight[w.starts[left] + k] << cut) != (eight[w.starts[mine[left]] + k] << cut)
    spelt = [w.text[w.starts[i] : w.stops[i]] for i in first.tolist()]
    if other.any():  # words that share a hash
        number = {}
        for i in np.flatnonzero(other).tolist():
            own = w.text[w.starts[i] : w.stops[i]]
            if own not in number:
                number[own] = len(spelt)
                spelt.append(own)
            ids[i] = number[own]
    return ids, spelt


def _spelt(texts: DataFrame, shared) -> DataFrame:
    """``lang, phrase, size`` of the occurrences that listed pointers name, with their ``f, g, pointer``; some more may come along.

    All occurrences with listed fingerprints are compared as words; a collision of both polynomials is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        seen: set[int] = set()  # pointers of repeated rows
        for w in _read(batches, langs):
            salts, names = _salts(langs), list(langs)
            fingerprints, pointers = shared.value
            ids, spelt = word_ids(w)
            good, columns = None, [[] for _ in range(6)]
            for n in range(1, LONGEST + 1):
                keep = w.inside(n)
                if good is not None:  # what is frequent has frequent parts
                    keep = keep & good[: len(keep)] & good[1 : len(keep) + 1]
                at = np.flatnonzero(keep)
                f = w.grams(n, salts)[at]
                found = listed(fingerprints, f)
                at, f = at[found], f[found]
                good = np.zeros(len(keep), bool)
                good[at] = True
                g = (w.grams(n, salts, 1)[at] >> U(32)).astype(np.uint32).view(np.int32)
                if collided(w, at, f, g, n, ids):
                    raise ValueError("two phrases share both fingerprints")
                pointer = w.pointers(at, n)
                named = np.flatnonzero(listed(pointers, pointer.view(np.uint64)))
                named = named[[p not in seen for p in pointer[named].tolist()]] if len(named) else named
                seen.update(pointer[named].tolist())
                words = ids[at[named][:, None] + np.arange(n)].tolist()
                values = (f[named].view(np.int64).tolist(), g[named].tolist(), pointer[named].tolist(), [names[k] for k in w.lang[at[named]].tolist()], [b" ".join([spelt[i] for i in x]) for x in words], [n] * len(named))
                for column, more in zip(columns, values, strict=True):
                    column.extend(more)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["f", "g", "pointer", "lang", "phrase", "size"])

    out = texts.mapInArrow(run, "f long, g int, pointer long, lang string, phrase binary, size int")
    return out.withColumn("phrase", F.col("phrase").cast("string")).dropDuplicates(["f", "g", "pointer"])


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to four words with at least ``least`` occurrences, and all words of each language.

    ``lang, phrase, size, f`` and ``lang, n``. Words and pieces are those of the texts with A-Z lowered; a null text has
    none, a null language is ``und``; repeated rows count each.
    """
    row = F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")))
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", row.alias("row")).where("text is not null")
    context = docs.sparkSession.sparkContext
    rounds, shared, fingerprints = [], None, np.zeros((PARTS, PART_BITS // 8), np.uint8)
    for orders, below in (((1,), 0), ((2,), 1), ((3, 4), 2)):
        counted = saved(_counted(texts, orders, below, shared).where(f"n >= {least} or f is null"))
        if shared is not None:
            shared.destroy()  # what it was for is written
        rounds.append(counted)
        own = bit_table(counted.where("f is not null").select("f"))
        fingerprints |= own
        shared = context.broadcast(own)  # PARTS x PART_BITS bits
    shared.destroy()
    counted = reduce(DataFrame.unionByName, rounds).where("f is not null").drop("lang")
    shared = context.broadcast((fingerprints, bit_table(counted.select(F.col("pointer").alias("f")))))
    frequent = saved(_spelt(texts, shared).join(counted, ["f", "g", "pointer"]).select("lang", "phrase", "size", F.col("n").alias("f")))
    shared.destroy()
    return frequent, rounds[0].where("f is null").select("lang", "n")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``lang, text``. A phrase of two to four words with ``a >= least``
    occurrences is cut where its parts, with ``l`` and ``r`` occurrences, give the lowest
    score ``floor(2000000 a / (l + r))``, of equal ones after the shortest first part. Phrases inside a longer one with
    four fifths of their occurrences are left out. Ranks go by score, then ``a``, then
    phrase, so they have no ties. A null or empty text has no words, a null language is ``und``; repeated rows count
    each; a very long text is hashed in parts; an empty table gives none. Other columns are ignored.
    """
    frequent, words = frequent_phrases(docs, least)
    split = F.split("phrase", " ")
    several = frequent.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", split.alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 * cast(a as decimal(20, 0)) as decimal(38, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inside = F.expr("explode(flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' ')))))")
    longer = several.where("size > 2").select("lang", inside.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    rest = best.join(longer, ["lang", "phrase"], "left").where("longer is null or cast(100 as decimal(20, 0)) * longer < cast(80 as decimal(20, 0)) * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rest = rest.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = rest.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(f"rank <= {top}")  # SALTS x top rows a language
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
