"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import (op1_line_dedup, op2_quality, op3_suffix_dedup, op4_jaccard_join, op5_html, op6_ann, op7_decontam, op8_toxicity,
               op9_reputation, op10_mixing, op11_conversation, op12_superminhash, op13_alignment)


def over(query: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query: the operator over whole tables of the folder."""
    return lambda spark, sf_dir: query(*[read_table(spark, sf_dir, t) for t in tables])


QUERIES = {
    "op1_line_dedup": over(op1_line_dedup.query, "documents"),
    "op2_quality": over(op2_quality.query, "documents", "labels"),
    "op3_suffix_dedup": over(op3_suffix_dedup.query, "documents"),
    "op4_jaccard_join": over(op4_jaccard_join.query, "documents"),
    "op5_html_text": over(op5_html.query, "pages"),
    "op6_ann": over(op6_ann.query, "embeddings"),
    "op7_decontamination": over(op7_decontam.query, "documents", "benchmark"),
    "op8_toxicity": over(op8_toxicity.query, "documents", "labels"),
    "op9_url_reputation": over(op9_reputation.query, "pages", "labels"),
    "op10_mixing": over(op10_mixing.query, "documents"),
    "op11_conversation_repair": over(op11_conversation.query, "conversations"),
    "op12_superminhash": over(op12_superminhash.query, "documents"),
    "op13_alignment": over(op13_alignment.query, "documents"),
}

ORACLE_SQL = {
    "op1_line_dedup": op1_line_dedup.ORACLE,
    "op3_suffix_dedup": op3_suffix_dedup.ORACLE,
    "op4_jaccard_join": op4_jaccard_join.ORACLE,
    "op7_decontamination": op7_decontam.ORACLE,
    "op9_url_reputation": op9_reputation.ORACLE,
    "op11_conversation_repair": op11_conversation.ORACLE,
    "op12_superminhash": op12_superminhash.ORACLE,
}
