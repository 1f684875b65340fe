"""A training corpus from documents: quality rules, line dedup, near-duplicate removal, decontamination, token ids.

Each stage works on all that the stage before it kept, and its decisions take effect. All but the last return the columns
of documents. Rows are judged by their texts (and sites), so ids may be null or repeated: each row has its own fate, and of
rows that are equal in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumachron.llm import decontaminate, jaccard_join, line_dedup, piece_tokens, quality_rules
from lumachron.llm.shared import scratch, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no learned rule rejects."""
    return quality_rules.good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines; n_chars is counted anew where lines were dropped."""
    found = line_dedup.without_boilerplate(docs)
    return found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents, that of the least id."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    found = piece_tokens.with_piece_ids(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("piece_tokens", tokens),
]

#: Learned rules and token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage wrote on its way goes as its result is written
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return docs
