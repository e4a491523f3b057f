"""The training-data pipeline: which documents, and how often, go into a corpus.

Each stage takes (spark, docs, sf_dir), keeps the columns of ``documents`` and
hands on what it kept; the last one adds the copies to take. ``run`` writes
every stage's result to the shared checkpoint folder and reads it back, so a
lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from equilens.llm import op1_line_dedup, op2_quality, op4_jaccard_join, op7_decontam, op10_mixing
from equilens.session import write_once
from equilens.sources.tables import read_table

#: Near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = op2_quality.train(docs, read_table(spark, sf_dir, "labels"))
    return op2_quality.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; text and n_chars follow."""
    return op1_line_dedup.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return op4_jaccard_join.keep_one(docs, words=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return op7_decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the copies that bring their sources to target; those without a copy go."""
    return op10_mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Trained and seeded stages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return docs
