"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of a bounded sample of
its training texts, which are taken whole. A text goes to the language whose
dictionary makes it smallest; a narrow margin is reported as a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm._shared import saved
from lumenfold.llm._words import pieces

#: the bound of the fitted sample: texts of each language at most, bytes that end it, languages
TEXTS, DICTIONARY, LANGUAGES = 1_000, 110_000, 500
SALTS = 64
NOT_LETTERS = r"[^\p{L}]+"
_PIECE = 1 << 17  # a compressor forgets its dictionary over long texts, so they go in pieces


def _letters(text):
    """The text's letters, lowered, and all else as spaces; null without a letter."""
    return F.when(text.rlike(r"\p{L}"), F.regexp_replace(F.lower(text), NOT_LETTERS, " "))


def dictionaries(training: DataFrame) -> dict[str, bytes]:
    """Raw dictionaries from ``lang, text, pick``: of each language whole texts by ``pick`` until ``DICTIONARY`` bytes are full.

    Texts above ``DICTIONARY`` bytes come last, so that a dictionary has at most
    twice as many bytes, or one cut text if a language has none but such. Rows with
    a null language, or without a letter, teach nothing. Ties of ``pick`` go by
    length and a hash of the text; repeated rows count as often as they stand
    there. More than ``LANGUAGES`` languages are an error.
    """
    rows = training.where("lang is not null").select("lang", "pick", F.xxhash64("text").alias("h"), F.col("text").alias("raw")).where(F.col("raw").rlike(r"\p{L}"))
    order = [F.octet_length("raw") > DICTIONARY, "pick", F.octet_length("raw"), "h"]
    sizes = rows.select("lang", "pick", "h", F.octet_length("raw").alias("size"), *(F.struct(*order).alias(k) for k in ("rank",)))
    # the first of each of SALTS shares of a language, then the first of these: no task sees a whole language
    near = sizes.withColumn("salt", F.pmod(F.xxhash64("pick", "h"), F.lit(SALTS))).withColumn("n", F.row_number().over(W.partitionBy("lang", "salt").orderBy("rank"))).where(f"n <= {TEXTS}")
    first = near.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("rank"))).where(f"n <= {TEXTS}")
    before = F.coalesce(F.sum("size").over(W.partitionBy("lang").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = saved(first.withColumn("before", before).where(f"before < {DICTIONARY}").groupBy("lang").agg(F.max("rank").alias("last")))
    if chosen.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    top = rows.join(F.broadcast(chosen), "lang").where(F.struct(*order) <= F.col("last"))  # a row for each language
    top = top.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(f"n <= {TEXTS}")
    out: dict[str, list[bytes]] = {}
    for row in top.select("lang", "n", F.substring(_letters(F.col("raw")), 1, DICTIONARY).alias("text")).orderBy("lang", "n").collect():  # LANGUAGES x 2 DICTIONARY bytes
        out.setdefault(row["lang"], []).append(row["text"].encode())
    return {k: b"\n".join(v)[: 2 * DICTIONARY] for k, v in out.items()}


def identify(docs: DataFrame, dicts: dict[str, bytes], level: int = 9, margin: float = 0.01) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``, one row per input row.

    The whole text counts, its letters lowered and all else as spaces, in pieces of
    128 KiB. ``score`` is the winner's share when sizes are turned to likelihoods;
    ``rejected`` if the second is within ``margin``. A null text, one without
    letters, or no dictionaries: ``und``, 0, rejected. Equal sizes go to the first
    language by name. Repeated rows are told each on its own; an empty table gives
    none. Other columns are ignored.
    """
    names, shared = sorted(dicts), docs.sparkSession.sparkContext.broadcast(dicts)  # LANGUAGES x 2 DICTIONARY bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for name in names:
            raw = zstandard.ZstdCompressionDict(shared.value[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)  # else every text would load the dictionary anew
            own.append(zstandard.ZstdCompressor(dict_data=raw, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
        for part, texts in pieces(batches):
            pred, score, rejected = [], [], []
            for text in texts:
                if not names or not text:
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                parts = [text[i : i + _PIECE] for i in range(0, len(text), _PIECE)]
                sizes = [sum(len(c.compress(p)) for p in parts) for c in own]
                best = min(sizes)
                at = sizes.index(best)
                unit = 2.0 + 0.01 * best
                pred.append(names[at])
                score.append(1.0 / sum(2.0 ** (-(s - best) / unit) for s in sizes))
                rejected.append(len(sizes) > 1 and sorted(sizes)[1] - best < margin * best)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    text = _letters(F.col("text")).cast("binary")
    return docs.select("doc_id", text.alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")
