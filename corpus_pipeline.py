"""The corpus pipeline: quality rules, exact dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept.  A stage's
result is written as Parquet to the shared folder and read back as the next stage's documents, so
an executor that is lost costs tasks of one stage.  All stages but the last return the columns of
their input: the quality stage drops rejected documents and replaces texts by their cleaned lines,
the dedup stages drop copies, the personal-data stage masks spans.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import cuckoo_dedup, near_dedup, packing, pii, quality
from cohortlab.llm.common import materialize, quoted, read
from cohortlab.session import ship_package


def clean_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with failing lines taken out."""
    stays = next(n for n in (f"stays{i}" for i in count()) if n not in docs.columns)
    judged = quality.clean(docs)
    columns = _with_text(docs, F.col("clean_text"))
    # written before the filter, which the optimizer would repeat inside the loops over the lines
    return materialize(judged.select(*columns, F.col("kept").alias(stays)), "cleaned").where(stays).drop(stays)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return cuckoo_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    ship_package(spark)
    return near_dedup.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the kind of it in angle brackets."""
    return pii.mask(docs).select(*_with_text(docs, F.col("masked_text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1,024 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs)


def _with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs``, held in ``row``, with the changed text and the character count that matches it."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns]


STAGES = [
    ("quality rules", clean_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

# Line rules, sketches, pattern induction and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the table of documents."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
