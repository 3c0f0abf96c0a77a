"""Vectorised hashing of the words of many texts, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: one random odd 64-bit value for each byte
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0], _powers[1]


#: bytes of text that are hashed at once: arrays of that many numbers are what a task's memory has to hold
PIECE = 1 << 18


def ranges(sizes: list[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, one text at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    return ranges([len(t) for t in texts], most)


def pieces(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with the bytes of a text column, null as empty; only a slice's texts are Python objects."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in ranges(sizes, most):
            part = batch.slice(a, b - a)
            yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the texts with A-Z lowered, and the words of each text."""
    buffer = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    power, back = powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * power[: len(buffer)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, begin))


_STEP = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed ``width``-word shingles (all words as one, if fewer), sorted within each text, and how many each text has."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width if n >= width else 0):
        rolled += hashes[j : n - width + 1 + j] * _STEP[j]
    rolled = mix(rolled)
    begin = np.cumsum(counts) - counts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.cumsum(sizes) - sizes
    values = np.empty(int(sizes.sum()), np.uint64)
    for at, size, own, count in zip(first.tolist(), sizes.tolist(), begin.tolist(), counts.tolist(), strict=True):
        if count >= width:
            values[at : at + size] = rolled[own : own + size]
            values[at : at + size].sort()
        elif count:
            values[at] = mix(np.sum(hashes[own : own + count] * _STEP[:count], keepdims=True, dtype=np.uint64) + U(count))[0]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[sizes > 0]] = True
    total = np.append(0, np.cumsum(new))
    return values[new], total[first + sizes] - total[first]
