"""Benchmark decontamination with word windows, in DataFrame functions only.

The windows of all benchmark items are a hash set that every task gets; each
document's windows are looked up by hash and then verified by their words. Up to
``MOST`` windows the set goes with the plan. Beyond that the hashes are a table of
two numbers a window, broadcast up to ``BROADCAST`` windows and joined in a shuffle
above; only the hashes of documents' windows meet it, and only texts with a hit are
read again for the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm._shared import ascii_lower, bound, saved, unused

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same words in a text that isn't lowered: ``TOKEN`` with A-Z
RAW_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, MOST, BROADCAST = 10, 50_000, 10_000_000
_HITS = "array<struct<start:int,len:int,gram:string>>"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _starts(words: Column, length: int) -> Column:
    return F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id string, len, gram, h``: the distinct windows of each item; an item of fewer words is one window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _words(F.col("text")).alias("w")).where("size(w) > 0")
    words = words.withColumn("len", F.least(F.size("w"), F.lit(window)))
    grams = words.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("g"))
    return grams.select("item_id", "len", F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("h")).distinct()


def with_hits(docs: DataFrame, windows: DataFrame, names: tuple[str, str] = ("n_words", "hits"), most: int = MOST, broadcast: int = BROADCAST) -> DataFrame:
    """Add the number of words and the hits (start from 1, len, gram; verified) of ``text`` to the rows of ``docs``.

    ``names`` are the new columns and must not be columns of ``docs``. A null text has no words.
    """
    distinct = windows.select("len", "gram", "h").distinct()
    found = distinct.limit(most + 1).collect()
    lengths = sorted({r["len"] for r in found})
    if len(found) <= most:

        def of_length(w: Column, n: int) -> Column:
            keys, grams = [r["h"] for r in found if r["len"] == n], [r["gram"] for r in found if r["len"] == n]
            is_hit = lambda g: F.xxhash64(g).isin(keys) & F.array_join(g, " ").isin(grams)
            starts = F.filter(_starts(w, n), lambda i: bound(F.slice(w, i, n), is_hit))
            return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.array_join(F.slice(w, i, n), " ").alias("gram")))

        def scan(w: Column) -> Column:
            return F.struct(F.size(w).cast("long").alias("n"), F.concat(F.array().cast(_HITS), *(of_length(w, n) for n in lengths)).alias("hits"))

        one = unused(docs, "scan")
        return docs.withColumn(one, bound(_words(F.col("text")), scan)).select(*(f"`{c}`" for c in docs.columns), F.col(one)["n"].alias(names[0]), F.col(one)["hits"].alias(names[1]))
    lengths = sorted(r["len"] for r in distinct.select("len").distinct().collect())  # at most ``window`` values
    row = unused(docs, "row_number")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    hashes = lambda w, n: F.transform(_starts(w, n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.xxhash64(F.slice(w, i, n)).alias("h")))
    every = rows.select(F.col(row).alias("at"), F.inline(bound(_words(F.col("text")), lambda w: F.flatten(F.array(*(hashes(w, n) for n in lengths))))))
    keys = saved(distinct.select("len", "h").distinct())
    keys = F.broadcast(keys) if keys.count() <= broadcast else keys  # two numbers a window
    near = saved(every.join(keys, ["len", "h"], "left_semi").groupBy("at").agg(F.collect_list(F.struct("start", "len")).alias("near")))
    texts = rows.select(F.col(row).alias("at"), "text").join(near, "at").select("at", "near", _words(F.col("text")).alias("w"))
    grams = texts.select("at", F.inline(F.transform("near", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), F.array_join(F.slice("w", x["start"], x["len"]), " ").alias("gram")))))
    hits = grams.join(distinct.drop("h"), ["len", "gram"], "left_semi").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "len", "gram"))).alias("found"))
    n_words = F.size(_words(F.col("text"))).cast("long").alias(names[0])
    return rows.join(hits, F.col(row) == F.col("at"), "left").select(*(f"`{c}`" for c in docs.columns), n_words, F.coalesce("found", F.array().cast(_HITS)).alias(names[1]))


def hit_positions(hits: Column) -> Column:
    """The distinct positions, from 1 and sorted, of the words inside the windows found."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST, broadcast: int = BROADCAST) -> DataFrame:
    """What each document shares with the benchmark.

    Returns ``doc_id, n_words, hit_words array<int>, items array<string>``, one row
    per input row. A null text has no words; a null or empty item has no window;
    an item with a null id marks words but isn't listed; rows that repeat an id
    are scanned each on its own. Other columns are ignored.
    """
    windows = saved(benchmark_windows(benchmark, window))
    base = saved(with_hits(docs.select("doc_id", "text"), windows, most=most, broadcast=broadcast).select("doc_id", "n_words", "hits", F.monotonically_increasing_id().alias("row")))
    clean = base.where("size(hits) = 0").select("doc_id", "n_words", F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items"))
    hits = base.where("size(hits) > 0").select("row", "doc_id", "n_words", hit_positions(F.col("hits")).alias("hit_words"), F.explode(F.array_distinct(F.transform("hits", lambda x: x["gram"]))).alias("gram"))
    items = windows.groupBy("gram").agg(F.collect_set("item_id").alias("ids"))
    dirty = hits.join(items, "gram").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("hit_words").alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    return clean.unionByName(dirty.drop("row"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5, most: int = MOST, broadcast: int = BROADCAST) -> DataFrame:
    """Cut the words of benchmark windows out of the texts; drop documents of which they are ``drop_share`` or more.

    Keeps all columns, whatever their names; ``n_chars`` follows the new text. Rows
    without a hit, null and empty texts too, stay as they are; repeated rows are cut
    each on its own; empty tables give and cut nothing. The hits are found once and
    written with the rows.
    """
    n_words, hits = unused(docs, "n_words"), unused(docs, "hits")
    rows = saved(with_hits(docs, saved(benchmark_windows(benchmark, window)), (n_words, hits), most, broadcast).withColumn(hits, hit_positions(F.col(hits))))
    rows = rows.where(F.size(hits) < F.greatest(F.lit(1e-9), F.col(n_words) * drop_share))
    parts = F.struct(F.split("text", RAW_TOKEN, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(RAW_TOKEN), F.lit(0)).alias("words"), F.col(hits).alias("hit"))

    def joined(x: Column) -> Column:
        """The gaps with the words that stay; array_except and a sort tell a word's side in about linear time."""
        kept = F.array_except(F.sequence(F.lit(1), F.size(x["words"])), x["hit"])
        word = lambda i, w: F.struct(i.alias("i"), w.alias("w"))
        own = F.array_sort(F.concat(F.transform(kept, lambda i: word(i, F.get(x["words"], i - 1))), F.transform(x["hit"], lambda i: word(i, F.lit("")))))
        return F.array_join(F.zip_with(x["gaps"], own, lambda gap, w: F.concat(gap, F.coalesce(w["w"], F.lit("")))), "")

    new = unused(rows, "new")
    rows = rows.withColumn(new, F.when(F.size(hits) > 0, bound(parts, joined)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    for i, c in enumerate(docs.columns):
        if c.lower() == "text":
            columns[i] = F.coalesce(F.col(new), F.col("text")).alias(c)
        if c.lower() == "n_chars":
            columns[i] = F.when(F.col(new).isNotNull(), F.length(new).cast(dict(docs.dtypes)[c])).otherwise(F.col(f"`{c}`")).alias(c)
    return rows.select(*columns)
