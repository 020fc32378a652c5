"""Helpers shared by the training-data operators: reading, shared folders, ordering."""

from __future__ import annotations

import ctypes
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.session import shared_dir, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents, over all cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by Spark's own reader, so that any path Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stored(threading.local):
    """Folders that ``store`` has written in this thread, so that no other query's tables are counted."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)


STORED = Stored()
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffles of the write are of no use to anything behind it, so they are deleted when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    STORED.paths.append(path)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table that ``store`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_stored(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Delete what ``store`` wrote in this thread behind the first ``since`` tables (up to ``until`` tables), once nothing reads it any more."""
    for path in STORED.paths[since:until]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del STORED.paths[since:until]


def replayable(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself if it only reads files (columns, filters), so that each pass over it has the same rows in the same splits; else a written copy."""

    def plain(node) -> bool:
        kids = node.children()
        return node.getClass().getSimpleName() in ("Project", "Filter", "LogicalRelation") and all(plain(kids.apply(i)) for i in range(kids.size()))

    return df if plain(df._jdf.queryExecution().optimizedPlan()) else store(df, label)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null ids count as remainder null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, read no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint only if a check shows that it is small; else the plain join is used."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def give_back() -> None:
    """Return freed memory of this process to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """Ascending upper bounds that split the values of an id column into about equal ranges.

    One pass over that column alone; the result has one number for each range, however
    many rows there are.
    """
    if parts <= 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    row = df.where(F.col(column).isNotNull()).agg(F.percentile_approx(column, F.array(*map(F.lit, probs)), 100 * parts).alias("q")).head()
    return sorted(set(row["q"] or []))


def deal_by_range(bounds: list[int], values: pa.Array) -> np.ndarray:
    """Range number of each value (nulls: 0)."""
    filled = values.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    return np.searchsorted(np.asarray(bounds, dtype=np.int64), filled, side="left").astype(np.int32)
