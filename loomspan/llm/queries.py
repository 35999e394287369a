"""One query per corpus operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, chat, decontaminate, html_text, licenses, line_dedup, near_dup, pii, topk, toxicity
from loomspan.session import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"), width=2)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(rows.unionByName(chat.probe(spark)))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {"op1_bpe": op1_bpe, "op2_near_dup": op2_near_dup, "op3_pii": op3_pii, "op4_line_dedup": op4_line_dedup, "op5_decontaminate": op5_decontaminate, "op6_toxicity": op6_toxicity, "op7_chat": op7_chat, "op8_topk": op8_topk, "op9_licenses": op9_licenses, "op10_html": op10_html, "base_pii": base_pii, "base_licenses": base_licenses}
ORACLE_SQL: dict[str, str] = {"op2_near_dup": near_dup.oracle(), "op4_line_dedup": line_dedup.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op7_chat": chat.ORACLE, "op8_topk": topk.ORACLE, "base_pii": pii.BASE_ORACLE, "base_licenses": licenses.BASE_ORACLE}
