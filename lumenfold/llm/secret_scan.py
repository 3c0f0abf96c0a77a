"""Secrets in texts: plain patterns, and strings that a public tokenizer can hardly shorten.

A vocabulary learned from public text has long tokens for words and identifiers, and
short ones for random characters. A run of 20 or more characters that holds letters
and digits (or mixes cases) and has fewer than ``RATIO`` characters a token is thus
taken for a secret, unless it is a known digest or an identifier: digests of a usual
length in hex, UUIDs, encoded digests with their algorithm in front, data and link
addresses, and words or short numbers joined by ``- _ / +``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._words import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ["assign", "access", "hex", "token"]
#: fewest characters of a run, fewest characters a token that count as plain text, characters that are counted at once
LEAST, RATIO, BLOCK = 20, 2.1, 4096
#: most bytes of a vocabulary file
VOCABULARY_BYTES = 64 << 20
#: fixed value: how the vocabulary's library cuts a text before it merges
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: fixed values: digests of nothing (md5, sha1, sha256), which many lists and logs show
KNOWN = frozenset(hashlib.new(name).hexdigest() for name in ("md5", "sha1", "sha256"))
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_PREFIXED = re.compile(r"(?ai)(?:sha-?(?:1|224|256|384|512)|md5|blake2[bs]|blake3)[-_=:].*")
_PART = re.compile(r"[A-Za-z]+|[A-Za-z]{1,12}[0-9]{1,4}|[0-9]{1,8}|[0-9]{1,4}[A-Za-z]{1,5}(?:[0-9]{1,4})?")
_ADDRESS = re.compile(r"(?:[a-z][a-z0-9+.-]*://|data:|www\.)[^\s\"'<>]*\Z", re.I)
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))


def encoder(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file's bytes: lines of a token in base64 and its rank."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def characters_a_token(run: str, tokens: tiktoken.Encoding) -> float:
    """A long run is counted in blocks, since merging a block isn't linear in its length."""
    return len(run) / sum(len(tokens.encode_ordinary(run[i : i + BLOCK])) for i in range(0, len(run), BLOCK))


def identifier(run: str, before: str, known: Iterable[str] = KNOWN) -> bool:
    """Whether a run is a known digest or an identifier; ``before`` is the text that leads up to it."""
    if _UUID.fullmatch(run) or run.lower() in known or _PREFIXED.fullmatch(run) or (_DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS):
        return True
    if _ADDRESS.search(before) or re.search(r"(?ai)(?:sha-?(?:1|224|256|384|512)|md5|blake2[bs]|blake3|commit|etag)[:=\x20-]*\Z", before):
        return True
    return all(_PART.fullmatch(x) for x in re.split(r"[-_/+]+", run.rstrip("=").strip("-_/+")))


def _mixed(run: str) -> bool:
    """Letters and digits, or a capital behind a small letter and a small letter behind two capitals, as words don't have."""
    letters, digits = re.search("[A-Za-z]", run), re.search("[0-9]", run)
    return bool(letters and digits) or bool(re.search("[a-z][A-Z]", run) and re.search("[A-Z]{2}[a-z]", run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain patterns' valid matches, by start and kind."""
    found, low = [], text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, base: list[tuple[int, int, int]], tokens, known: Iterable[str] = KNOWN, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Further spans that the tokenizer exposes, clear of ``base``, sorted by start; ``tokens()`` gives the tokenizer."""
    taken, found, at = [], [], 0
    for start, _, end in base:  # as places that don't overlap
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    for m in _RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        run = m.group()
        if (at == len(taken) or taken[at][0] >= m.end()) and _mixed(run) and not identifier(run, text[max(0, m.start() - 200) : m.start()], known):
            if characters_a_token(run, tokens()) < ratio:
                found.append((m.start(), 3, m.end()))
    return found


_encoders: dict[bytes, tiktoken.Encoding] = {}


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> bytes:
    """A vocabulary file's bytes, read by Spark, so that only the driver's store has to have it; at most ``VOCABULARY_BYTES``."""
    row = spark.read.format("binaryFile").load(path).where(F.col("length") <= VOCABULARY_BYTES).first()
    if row is None:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return bytes(row["content"])


def find_secrets(docs: DataFrame, path: str = VOCABULARY, known: Iterable[str] = KNOWN, ratio: float = RATIO) -> DataFrame:
    """``doc_id, spans array<struct<kind int, start int, end int>>``, one row per input row; kinds are places in KINDS.

    Spans are code points, end exclusive, sorted by start, then kind; spans of plain
    patterns come whatever the tokenizer says. ``known`` are further digests, in lower
    case, to leave out. A null or empty text has none, nor does a null id change
    anything; repeated rows are scanned each on its own; a run without end is scanned whole;
    an empty table gives none. A run of exactly ``ratio`` characters a token is none.
    Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(vocabulary(spark, path))
    known = frozenset(known)
    kind = dict(docs.dtypes)["doc_id"]

    def tokens() -> tiktoken.Encoding:
        """Built once in a worker."""
        raw = ranks.value
        if hash(raw) not in _encoders:
            _encoders[hash(raw)] = encoder(raw)
        return _encoders[hash(raw)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for part, texts in pieces(batches):
            out = []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                out.append([{"kind": k, "start": a, "end": b} for a, k, b in sorted(base + token_spans(text, base, tokens, known, ratio))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, span)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:int,start:int,end:int>>")
