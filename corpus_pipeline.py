"""The corpus pipeline: five stages over documents, each of one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents. Empty tables pass through; null texts go with the language stage, which
can't tell their language.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapewise.llm import bpe, decontaminate, jaccard_join, language, line_dedup  # noqa: E402
from tapewise.llm.common import shared_path  # noqa: E402
from tapewise.llm.queries import table, vocabulary  # noqa: E402
from tapewise.session import ship, short_batches  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    ship(spark)
    short_batches(spark)
    return language.accepted(docs)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents; n_chars follows the text."""
    return line_dedup.drop_boilerplate(docs, counted="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    short_batches(spark)
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the documents that are left, with counts and digests."""
    ship(spark)
    short_batches(spark)
    return bpe.report(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", boilerplate), ("jaccard_join", near_duplicates),
          ("decontamination", decontamination), ("bpe", token_ids)]

#: Language identification and encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
