"""Corpus cleaning and packing: toxicity, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns rows that are written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from epiframe.llm.common import discard, stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 5 does not predict toxic."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines cut; those left without any line go, n_chars is renewed."""
    out = line_dedup.without_repeated_lines(docs, **line_dedup.EVERY_LINE)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8)."""
    return near_dup.drop_near_duplicates(docs, size=5, share=(80, 100))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 1024."""
    return packing.pack_documents(docs, 1024, 2)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Neighbour votes, edit distances, sketches and tokenizers are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return made
        made = stored(made, name)
        if n:
            discard(docs)
        docs = made
    return docs
