"""The training-data pipeline over `documents`: quality rules, line dedup, n-gram Jaccard join,
benchmark decontamination, SentencePiece encoding.

Each stage works on all that the one before kept, written as Parquet and read again, so that a
lost executor recomputes one stage at most. All stages but the last return the columns of their
input; the last adds ids, n_tokens and round_trip. Nulls, empty texts, repeated rows and empty
tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import decontamination, jaccard, lines, quality, sentencepiece
from tributary.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's thresholds reject go."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go; text and n_chars are what is left. A document of
    which no word is left, a copy of others, goes."""
    return lines.dedup_text(docs, keep_emptied=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of smallest id stays."""
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return sentencepiece.with_tokens(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: The last stage can't be expressed in SQL; tests/llm compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            # By position, as names of extra columns may clash in a file.
            docs = stash(docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))).toDF(*docs.columns)
    return docs
