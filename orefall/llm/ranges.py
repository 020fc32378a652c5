"""Rows dealt to partitions by ranges of an id, without a sampling pass over the texts.

The bounds come from a pass over the id column alone; texts cross the shuffle once, packed
with zstd, and arrive in partitions that hold ascending ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import deal_by_range, id_bounds, shuffle_partitions

DEALT = "part int, halo int, doc_id long, payload binary"


@dataclass(frozen=True)
class Ranges:
    """Ranges of ids: the greatest id of each but the last, and the greatest of all where it is needed."""

    bounds: list[int]
    top: int | None

    @classmethod
    def of(cls, docs: DataFrame, halo: bool = False, parts: int | None = None) -> Ranges:
        ids = docs.select(F.col("doc_id").cast("long"))
        bounds = id_bounds(ids, "doc_id", parts or shuffle_partitions(docs.sparkSession))
        top = ids.agg(F.max("doc_id")).head()[0] if halo else None
        if bounds and top is not None and bounds[-1] >= top:
            bounds.pop()
        return cls(bounds, top)

    def deal(self, rows: DataFrame) -> DataFrame:
        """Rows with a column part, one partition a range."""
        return rows.repartitionById(len(self.bounds) + 1, F.col("part"))


def dealt_texts(docs: DataFrame, halo: bool = False, parts: int | None = None, pack: bool = True) -> DataFrame:
    """``spread_texts`` by ranges of ``docs`` itself, partition number = range number."""
    ranges = Ranges.of(docs, halo, parts)
    return ranges.deal(spread_texts(docs, ranges, halo, pack))


def spread_texts(docs: DataFrame, ranges: Ranges, halo: bool = False, pack: bool = True) -> DataFrame:
    """(part, halo, doc_id, payload): texts packed with zstd or as plain UTF-8, with the number of their range.

    Null ids come before all others and null texts count as empty. With ``halo``, each
    range also gets, marked 1, the rows of the id just below it (the lowest range: the rows
    of the greatest id).
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bounds, top = ranges.bounds, ranges.top

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ids = b.column("doc_id")
            part = deal_by_range(bounds, ids)
            text = b.column("text").fill_null("").cast(pa.binary())
            packed = pa.array(map(zip_.compress, text.to_pylist()), pa.binary()) if pack else text
            batch = pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), np.int32)), ids, packed], names=["part", "halo", "doc_id", "payload"])
            yield batch
            if not halo:
                continue
            raw = ids.to_numpy(zero_copy_only=False) if ids.null_count == 0 else np.array([x if x is not None else -(2**63) for x in ids.to_pylist()], np.int64)
            if bounds:
                below = np.flatnonzero(np.isin(raw, np.array(bounds, np.int64)))
                if len(below):
                    more = batch.take(pa.array(below))
                    yield pa.RecordBatch.from_arrays([pa.array((part[below] + 1).astype(np.int32)), pa.array(np.ones(len(below), np.int32)), more.column(2), more.column(3)], names=batch.schema.names)
            wrap = np.flatnonzero(raw == (top if top is not None else -(2**63)))
            if len(wrap):
                more = batch.take(pa.array(wrap))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(wrap), np.int32)), pa.array(np.ones(len(wrap), np.int32)), more.column(2), more.column(3)], names=batch.schema.names)

    return docs.mapInArrow(spread, DEALT)
