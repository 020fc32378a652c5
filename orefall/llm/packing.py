"""Conflict-constrained best-fit packing of documents into bins of fixed length.

Items are dealt to shards by a hash of their id, so that each shard has about the same number
whatever their source. In a shard, items go longest first into the bin with the smallest
residual that they fit and that has no document of the same source or duplicate cluster.
Bins are ordered by residual in a tree whose nodes carry the intersection of their bins'
bitmaps of sources and clusters: the successor search skips a node that conflicts as a whole
and goes on until the tightest compatible bin is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ITEMS = 8192
PLACED = "doc_id long, piece int, length int, bin long, offset int"


class Bins:
    """Bins by residual 0..capacity: leaves of a binary tree, each node with the AND of its bins' bitmaps."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.all = -1  # every bit set: the bitmap of a leaf without bins conflicts with anything
        self.tree = [self.all] * (2 * self.size)
        self.leaves: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]

    def _refresh(self, residual: int) -> None:
        both = self.all
        for bitmap in self.leaves[residual]:
            both &= bitmap
        at = residual + self.size
        while at and self.tree[at] != both:
            self.tree[at] = both
            at >>= 1
            if at:
                both = self.tree[2 * at] & self.tree[2 * at + 1]

    def add(self, residual: int, bitmap: int, number: int) -> None:
        self.leaves[residual].setdefault(bitmap, []).append(number)
        self._refresh(residual)

    def take(self, least: int, wanted: int) -> tuple[int, int, int] | None:
        """Remove and return (residual, bitmap, number) of the first bin with residual >= least and no bit of wanted."""
        at = least + self.size
        while True:
            found = self._descend(at, wanted)
            if found is not None:
                residual, bitmap = found
                numbers = self.leaves[residual][bitmap]
                number = numbers.pop()
                if not numbers:
                    del self.leaves[residual][bitmap]
                    self._refresh(residual)
                return residual, bitmap, number
            while at & 1:  # a right child: its sibling was searched or lies below
                at >>= 1
            if at <= 1:
                return None
            at += 1

    def _descend(self, top: int, wanted: int) -> tuple[int, int] | None:
        stack = [top]
        while stack:
            at = stack.pop()
            if self.tree[at] == self.all or (wanted and self.tree[at] & wanted):
                continue
            if at >= self.size:
                for bitmap in self.leaves[at - self.size]:
                    if not bitmap & wanted:
                        return at - self.size, bitmap
            else:
                stack += (2 * at + 1, 2 * at)
        return None


def pack(lengths: np.ndarray, sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, length, bin, offset) for the items of one shard, in order of length (longest first, then as given).

    An item longer than a bin is cut: full pieces fill bins of their own, the rest is placed
    like an item. An item of length 0 takes no room and goes to no bin (-1). Items without a
    source (None) conflict with no source; the same holds for clusters.
    """
    bits: dict = {}
    common = {c for c, n in zip(*np.unique([c for c in clusters if c is not None], return_counts=True), strict=True) if n > 1} if any(c is not None for c in clusters) else set()
    out, bins, made, fill = [], Bins(capacity), 0, []
    rests = []
    for i, n in enumerate(lengths.tolist()):
        full, rest = divmod(n, capacity)
        for p in range(full):
            out.append((i, p, capacity, made, 0))
            fill.append(capacity)
            made += 1
        if rest:
            rests.append((-rest, i, full))
        elif not n:
            out.append((i, 0, 0, -1, 0))
    for minus, i, piece in sorted(rests):
        n, wanted = -minus, 0
        if sources[i] is not None:
            wanted |= 1 << bits.setdefault(("s", sources[i]), len(bits))
        if clusters[i] in common:
            wanted |= 1 << bits.setdefault(("c", clusters[i]), len(bits))
        got = bins.take(n, wanted)
        if got is None:
            got = (capacity, 0, made)
            fill.append(0)
            made += 1
        residual, bitmap, number = got
        out.append((i, piece, n, number, fill[number]))
        fill[number] += n
        if residual > n:
            bins.add(residual - n, bitmap | wanted, number)
    return out


def item_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length, source, cluster): words split at white space; cluster is a hash of the words, equal for texts that differ in blanks and ASCII case only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in b.column("text").to_pylist()]
            marks = [xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63) for w in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in words], pa.int32()), b.column("source"), pa.array(marks, pa.int64())], names=["doc_id", "length", "source", "cluster"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).mapInArrow(run, "doc_id long, length int, source string, cluster long")


def best_fit(items: DataFrame, n_items: int, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, length, bin, offset) for items (doc_id, length, source, cluster).

    ``n_items`` sets the number of shards; bins are numbered shard by shard. Bins hold at
    most one document of a source and one of a cluster. Null ids, sources and clusters are
    allowed; repeated rows are items of their own; an empty table gives no rows.
    """
    shards = max(1, -(-n_items // shard_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] or 0))
            placed = pack(np.array([max(0, r[2] or 0) for r in rows], np.int64), [r[3] for r in rows], [r[4] for r in rows], capacity)
            item, piece, length, number, offset = (np.array(c, np.int64) for c in zip(*placed, strict=True))
            ids = pa.array([r[1] for r in rows], pa.int64()).take(pa.array(item))
            bins = np.where(number >= 0, (np.int64(rows[0][0]) << 32) + number, -1)
            return pa.RecordBatch.from_arrays([ids, pa.array(piece.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(bins), pa.array(offset.astype(np.int32))], names=["doc_id", "piece", "length", "bin", "offset"])

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and row[0] != held[0][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    dealt = items.select(F.pmod(F.xxhash64("doc_id", "length", "cluster"), F.lit(shards).cast("long")).cast("int").alias("shard"), "doc_id", "length", "source", "cluster")
    spread = dealt.repartitionById(min(shards, 20_000), F.col("shard") % min(shards, 20_000)).sortWithinPartitions("shard", "doc_id", "length", "cluster")
    placed = spread.mapInArrow(run, PLACED)
    return placed.withColumn("bin", F.when(F.col("bin") >= 0, F.col("bin")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Best-fit bins for the whole texts of ``docs`` (doc_id, text, source), lengths in words."""
    return best_fit(item_lengths(docs), docs.count(), capacity)
