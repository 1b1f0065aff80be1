"""The text pipeline: documents in, tokens out, one written table between stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracefp.llm.bpe import bpe, default_tokenizer
from tracefp.llm.contamination import decontaminate
from tracefp.llm.lines import line_dedup
from tracefp.llm.simhash import simhash_dedup
from tracefp.llm.toxicity import keep_clean, train_toxicity
from tracefp.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold by the network trained on the labels; a text
    without words is never toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, train_toxicity(docs, labels))


def one_line_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays once in the corpus, where it is similar too; documents stay,
    empty if all their lines went, and n_chars follows the text."""
    return line_dedup(docs, n_chars_col="n_chars").select(*docs.columns)


def one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies (SimHash at two or fewer bits by
    Golay keys, or five-word Jaccard 0.8) stays."""
    return simhash_dedup(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)."""
    return bpe(docs, default_tokenizer()).selectExpr("doc_id", "CAST(length(ids) / 4 AS BIGINT) AS n_tokens", "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("line_dedup", one_line_each),
    ("simhash_dedup", one_of_a_group),
    ("decontamination", no_benchmark),
    ("bpe", tokens),
]

# Fingerprints, a trained network and BPE are not SQL; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
