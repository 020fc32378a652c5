"""Readers and sinks: tolerant JSON lines, exports, upserts by key, source fallbacks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.session import shared_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder among the shared ones."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are skipped."""
    marked = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    names = [c for c in marked.columns if c != "_bad"]
    return marked.where(F.col("_bad").isNull() & F.coalesce(*[F.col(c).cast("string") for c in names]).isNotNull()).select(*names)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def split_sinks(rows: DataFrame, reason: str, path: str) -> None:
    """Passed and rejected rows to their folders, in one pass over the rows, by partition."""
    rows.withColumn("sink", F.when(F.col(reason) == "passed", "passed").otherwise("rejected")).write.partitionBy("sink").mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` whose key is not in ``new``, and all of ``new``."""
    return current.join(new.select(key).distinct(), key, "left_anti").select(current.columns).unionByName(new.select(current.columns))


def usable_vectors(docs: DataFrame, dim: int) -> DataFrame:
    """Rows with an embedding of the wanted length."""
    return docs.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim))


def whole_source(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first source, and those of the second for keys that the first does not answer at all."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti").select(first.columns))


def content_of(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Content by key from the first source, else from the second; also where the first has null."""
    a, b = first.select(key, F.col("content").alias("_a")), second.select(key, F.col("content").alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_a", "_b").alias("content"))


def decoded(raw: DataFrame, key: str, packed: str) -> DataFrame:
    """Base64 to UTF-8 text; null where either fails."""
    return raw.select(key, F.try_validate_utf8(F.expr(f"try_to_binary({packed}, 'base64')").cast("string")).alias("content"))


def drop_partition(spark: SparkSession, rows: DataFrame, column: str, value: str, path: str) -> DataFrame:
    """Write ``rows`` by partition and drop one: the table without it."""
    rows.write.partitionBy(column).mode("overwrite").parquet(path)
    return spark.read.parquet(path).where(F.col(column) != value)
