"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orefall.llm import langid, multiindex, packing, pieces, secrets, simhash, spotsigs, tokenfiles, toxicity, urlfilter
from orefall.llm.common import documents, table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the library that holds them is looked up only when it is needed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents(spark, sf_dir), toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfiles.encode_to_files(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return tokenfiles.ids_digest(tokenfiles.read_token_files(spark, path))


def op6_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(documents(spark, sf_dir), langid.train(docs))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.listed_urls(spark))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    return pieces.encode_digest(documents(spark, sf_dir), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_simhash, op3_secrets, op4_spotsigs, op5_token_files, op6_multiindex, op7_best_fit, op8_language, op9_url_filter, op10_sentencepiece)
}
ORACLES: dict[str, str] = {"op9_url_filter": urlfilter.oracle()}
