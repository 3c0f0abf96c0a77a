"""A cleaning pipeline over ``documents``: each stage gets what the stage before has kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
keep the columns of ``documents``, whatever further columns those have. Nulls in
any column and empty texts pass through; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, minhash, mixing, pii, quality
from lumenfold.llm._shared import saved, table, unused


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    A null or empty text has the classifier's bias as its score. Repeated rows are
    judged alike. Without labels nothing is dropped.
    """
    weights = quality.train(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    name = unused(docs, "quality")
    return quality.score(docs, weights, docs.columns, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each group of near duplicates.

    Rows that repeat a doc_id are one document: the first by text stays. Rows with a
    null doc_id, and documents without words, belong to no group and stay.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
    number = unused(docs, "number")
    one = named.withColumn(number, F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where(F.col(number) == 1).drop(number)
    return one.unionByName(docs.where("doc_id is null"))


def _decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that mostly consist of them.

    A null text has no words and stays; repeated rows are cut each on its own.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def _redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by placeholders; null and clean texts stay as they are."""
    return pii.redacted(docs)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, beside its doc_id, source and text.

    A null source is a source of its own; a null or empty text takes 0 words.
    """
    return mixing.mix_sources(docs, keep=["source", "text"])


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("decontaminated", _decontaminated), ("redacted", _redacted), ("mixed", _mixed)]

#: hashing, training and rounding can't be said in SQL; the tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
