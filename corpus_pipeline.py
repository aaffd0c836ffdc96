"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes the documents that its predecessor kept and returns documents with all their columns; the last
returns the packed pieces. Documents that fail the quality rules go. Lines that repeat an earlier line go, and with
them documents of which nothing is left. Of each class of near copies the document with the smallest id stays.
Documents with a benchmark window go as a whole. NULL and empty texts fail the quality rules; repeated rows fold in
the join stage. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import common as c
from riskweave.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, c.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", new_lines),
    ("ngram_join", one_of_each),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]
ORACLE_SQL = None  # packing is no SQL; the tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again before the next."""
    docs = c.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = c.materialise(docs)
    return docs
