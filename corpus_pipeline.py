"""A training-corpus pipeline over `documents`: language ID, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents; the last returns packed pieces. Further columns come through. Every stage takes an empty table to an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import langid, mixing, neardup, packing, repeats
from quillgraph.llm.store import dropped, written
from quillgraph.ship import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a text in a known language: null and empty texts, those without a letter, and those whose
    letters are mostly of no learned language. A null lang is filled in; repeated rows fare alike."""
    ship(spark)
    return langid.without_rejects(docs, docs.where(langid.remainder(F.col("doc_id"), 3) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near duplicates, null ids last. Texts are told apart by
    their words: different texts under one id, or without one, all stay; of repeated rows one does."""
    ship(spark)
    return neardup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has already; a null id counts as the largest, rows with one id
    leave each other alone, null texts stay null, and a text may end up empty."""
    ship(spark)
    return repeats.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources needs it; no source (null) is a source, and texts without a word
    weigh nothing but may be taken. Reruns agree."""
    ship(spark)
    return mixing.resampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences. Each copy of a document is packed on its own: its pieces start at 0 again."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Suffix-array, sampling and packing stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
