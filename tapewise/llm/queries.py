"""Registered queries of the operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewise.llm import bpe, chat, decontaminate, jaccard_join, language, line_dedup, records, repair, runs, secrets, sketch, toxicity, vector_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


@query("op1_line_dedup", line_dedup.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, counts=True, copies_once=False)  # its SQL counts rows


@query("op2_signature_tree_join", jaccard_join.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents"))


@query("op3_toxicity_chain")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_vector_near_dedup", vector_join.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_token_records")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.report(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op6_forced_boundary_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op7_chat_formatting", chat.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


@query("op9_decontamination", decontaminate.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return secrets.report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_conversation_repair", repair.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


@query("op13_bottom_k_fingerprints", sketch.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.report(table(spark, sf_dir, "documents"))
