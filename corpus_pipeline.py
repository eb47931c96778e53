"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Defined cases, for every stage: a null or empty text has no words, is rejected by the quality rules and so never
reaches the later stages of run(); called on their own, these keep it as it is (packing: a piece of one token).
Rows with a null id are kept, are linked with nothing and lose words to any other document; rows with one id
count as one document among near duplicates and are else judged row by row. Empty tables give empty tables, and
further columns of any name are carried along to the last stage.
""" 
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import near_dedup, packing, quality_rules, secret_scans, substring_dedup
from spanloom.llm.common import read
from spanloom.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees let pass."""
    return quality_rules.keep(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has."""
    return substring_dedup.remove(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark."""
    return secret_scans.redact(docs, secret_scans.repository())


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring duplicates", substrings),
    ("secret scans", secrets),
    ("packing", sequences),
]

#: Trees, similarity groups and packing have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), ()
    for name, stage in STAGES[:-1]:
        table = name.replace(" ", "_")
        docs = scratch.save(stage(spark, docs, sf_dir), table)
        scratch.drop(*last)
        last = (table,)
    return STAGES[-1][1](spark, docs, sf_dir)
