"""The subpackage's queries, one for each operator, over whole tables; and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statefold.llm import language_id, max_score, n_gram_join, packing, pieces_codec, quality_classifier, quality_rules, secret_forest, token_files, toxicity
from statefold.llm.common import table
from statefold.llm.sql import SQL


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; every worker has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return max_score.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.findings(table(spark, sf_dir, "documents"), secret_forest.fit(secret_forest.labelled_findings(spark)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_pieces_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_n_gram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_gram_join.join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_max_score, op4_quality_classifier, op5_secret_forest, op6_language_id, op7_packing, op8_pieces_codec, op9_token_files, op10_n_gram_join)
}


__all__ = ["QUERIES", "SQL"]
