"""A corpus pipeline of five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``.  An empty table passes through every stage; null texts are rejected by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilspark.llm import op2_jaccard_join, op4_quality_rules, op7_mix_sources, op8_byte_bpe, op9_line_dedup
from tilspark.llm.scratch import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op4_quality_rules.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; n_chars follows the text."""
    out = op9_line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates."""
    return op2_jaccard_join.dedup_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents repeated by their source's rate, in global random order."""
    return op7_mix_sources.mix_sources(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: each document's token ids, little-endian unsigned 32-bit."""
    return op8_byte_bpe.byte_bpe(docs).drop("decoded")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("mix_sources", mixing),
    ("byte_bpe", encoding),
]

#: the last stage merges by rank, which SQL can't express; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
