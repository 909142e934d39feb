"""The corpus pipeline: filter by quality and toxicity, drop near copies, mask secrets, pack into sequences.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that is written as Parquet
and reread as the next stage's ``docs``. All but the last return the columns of ``docs``. Models are fitted to the stage's
own documents and the labels in ``sf_dir``. Null and empty texts pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statefold.llm import n_gram_join, packing, quality_classifier, secret_forest, toxicity
from statefold.llm.common import materialize, table
from statefold.llm.registry import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return n_gram_join.representatives(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_forest.redact(docs, secret_forest.fit(secret_forest.labelled_findings(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_copies", one_of_each_group), ("secrets", secrets_masked), ("packing", packed)]

#: Learned models and tokenizers are not for SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
