"""A corpus from raw documents: toxic ones go, repeated lines and near copies go, benchmark
passages go, the rest is encoded.

Each stage takes all that its predecessor kept, as Parquet, and its decisions take effect. All
but the last return the columns of ``documents``; the last one returns a row per document with
its tokens counted and digested, and decoded again. Rows: as each operator's module says;
nulls, empty texts and repeated rows pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from loomspan.session import materialize, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity operator predicts to be toxic."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With repeated lines gone from the texts; n_chars follows the text."""
    return line_dedup.dedup(docs).select(COLUMNS[:-1]).selectExpr("*", "cast(length(text) as bigint) as n_chars")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by the contract of the near-dedup operator:
    two words a shingle, similarity from 0.8. One edited word spoils two shingles of two words
    but five of five, which would lose most near copies of short documents."""
    return near_dup.dedup(docs, width=2).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(docs)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmark), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, *before)  # what the stage has read
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
