"""From documents to token files: the stages of a training-data pipeline, each whole and in turn.

quality classifier -> MinHash near-dedup -> benchmark decontamination -> mixing -> token files.
Every stage works on all rows its predecessor kept. What the mix takes twice is two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripletide.llm.mixing import mixed
from tripletide.llm.near_dup import keep_first
from tripletide.llm.quality import keep_good
from tripletide.llm.queries import WEIGHTS, tokenizer
from tripletide.llm.tables import saved, table
from tripletide.llm.templates import without_leaks
from tripletide.llm.token_files import token_digest

# Documents that share so many hundredths of their five-word shingles, or more, are near-duplicates.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_first(docs, percent=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their weights."""
    return mixed(docs, WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is written as token files and read back."""
    return token_digest(docs, tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token files", tokens),
]

# The sets, models and files of the stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
