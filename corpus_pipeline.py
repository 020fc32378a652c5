"""The corpus pipeline: toxicity, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orefall.llm import langid, packing, secrets, shingles, toxicity
from orefall.llm.common import STORED, delete_stored, documents, shared_dir, table
from orefall.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores 0.5 or more go; null and empty texts stay, rows that repeat are judged alike, an empty table stays empty."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) or without a clear language go; where no language is learned, those with a letter stay."""
    ship(spark)
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard likeness 0.8 or more) the rows with the smallest doc_id stay.

    Pairs are proposed by the SimHash operator's pigeonhole blocks, and by MinHash bands where
    they differ in more bits than blocks can reach. Rows without doc_id stay.
    """
    ship(spark)
    return shingles.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked and n_chars follows. Null and empty texts hold none."""
    ship(spark)
    return secrets.redact_secrets(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with bin and offset; a document without words has no bin."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_bins),
]

#: Trained models and components of a graph are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet to the shared folder and read again.

    A stage's own tables are deleted when its output is written.
    """
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        before = len(STORED)
        stage(spark, docs, sf_dir).write.parquet(path)
        delete_stored(spark, before)
        docs = spark.read.parquet(path)
    return docs
