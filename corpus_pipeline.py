"""The corpus pipeline: stages over ``documents``, each written as Parquet and
reread as the next one's input.

Quality rules, line dedup, near-duplicate removal, benchmark decontamination,
SentencePiece coding. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ticketlake.llm import bagminhash, decontamination, line_templates, quality_rules, sentencepiece_bpe
from ticketlake.llm.common import table
from ticketlake.session import scratch_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules reject go."""
    return quality_rules.passed(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines of recurring templates go, but for a template's first line."""
    return line_templates.without_recurring(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each class of near-duplicates stays."""
    return bagminhash.one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that overlap a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token counts and digests of ids and decoded text."""
    return sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates),
          ("decontamination", contamination), ("sentencepiece", tokens)]

# No stage can be said in SQL; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
