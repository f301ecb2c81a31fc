"""A training corpus from raw documents: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Every stage works on all that the stage before it kept. The first four return the columns of
``documents``; the last returns the packed pieces. Every stage takes nulls in any column, empty
and very long texts, repeated rows and ids, an empty table, and more columns of any name, which it
keeps: null and empty texts are clean, have no near copy, no leak and no personal data, and make a
piece of one id; rows that repeat are judged alike; rows without an id are judged by their text,
but near-duplicates can't name them and keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import decontamination, near_dedup, packing, pii, queries, toxicity
from tidebar.llm.common import materialize, table, workdir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of five-word-shingle similarity 0.8 or more."""
    return near_dedup.keep_one_of_each(docs, similarity=(80, 100))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of the benchmark."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"), window=10, unnamed=True)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms and n_chars of changed texts made anew."""
    name = max(docs.columns, key=len) + "_found"  # longer than any column, so none is overwritten
    found = pii.pseudonymize(docs, queries.pii_key(spark), found_col=name)
    counted = F.when(F.size(F.col(f"`{name}`")) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", counted).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", pseudonymize),
    ("packing", pack),
]

#: SQL can't fit the classifier or run the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; returns the packed pieces."""
    folder, docs = workdir(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
