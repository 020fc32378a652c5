"""SimHash near-duplicates: pigeonhole blocks, equi-join on blocks, then Hamming checks.

A fingerprint is split into ``blocks`` parts. Two fingerprints that differ in at most
``max_bits`` bits agree on at least ``blocks - max_bits`` whole parts, so each of the
combinations of that many parts is one key space (here 10 spaces with keys of 25 or 26
bits), and all close pairs meet in one of them. The keys are wide, so the number of
candidates stays near the number of true links.

Equal fingerprints are folded to one representative first. A key with more than ``tile``
fingerprints is dealt in tiles (pairs of chunks), so no task holds an unbounded group;
each tile puts out a spanning forest of the links that it finds, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import maybe_broadcast, store
from orefall.llm.components import connected_components

BITS = 64


def fingerprint_bytes(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, words split at ASCII blanks, word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split are ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return simhash_of([xxhash.xxh64_intdigest(g, 42) for g in grams])


def simhash_of(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes. Sums run in slices, so memory stays bounded."""
    n, ones = len(hashes), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        part = np.array(hashes[at : at + 65536], dtype=np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_bytes(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _spans(blocks: int) -> list[tuple[int, int]]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """A mask of kept bits for each combination of blocks - max_bits blocks, as signed longs."""
    out = []
    for combo in combinations(_spans(blocks), blocks - max_bits):
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in combo)
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _forest(fp: np.ndarray, rep: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph of links left-right: (node, smallest node) pairs of rep."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(rep, kind="stable")
    rank = np.empty(len(rep), np.int64)
    rank[order] = np.arange(len(rep))
    label = rank.copy()
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[order[new]])
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != rank)
    return rep[moved], rep[order[label[moved]]]


SMALL_RUN = 24


def _links_in_runs(fp: np.ndarray, run: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within runs of equal keys that differ in at most max_bits bits."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left, right = [], []
    big = sizes > SMALL_RUN
    for shift in range(1, int(min(SMALL_RUN, sizes.max(initial=1)))):
        i = np.flatnonzero(run[:-shift] == run[shift:])
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= max_bits]
        left.append(i)
        right.append(i + shift)
    for at, size in zip(starts[big], sizes[big], strict=True):
        part = fp[at : at + size]
        for lo in range(0, size, 256):
            near = np.bitwise_count(part[lo : lo + 256, None] ^ part[None, :]) <= max_bits
            a, b = np.nonzero(near)
            keep = a + lo < b
            left.append(a[keep] + lo + at)
            right.append(b[keep] + at)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _tile_links(max_bits: int):
    """Streams rows sorted by key; a key's rows are together and bounded, so a batch ends at a key's end."""

    def solve(k: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        a, b = _forest(fp, rep, *_links_in_runs(fp, k, max_bits))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols[3] = cols[3].view(np.uint64)
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            n = len(cols[0])
            if not n:
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield solve(_keys([c[:cut] for c in cols]), cols[3][:cut], cols[4][:cut])
        if held is not None and len(held[0]):
            yield solve(_keys(held), held[3], held[4])

    return run


def _keys(cols: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    for c in cols[:3]:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def hamming_links(reps: DataFrame, max_bits: int = 3, blocks: int = 5, tile: int = 512) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of ``reps`` (rep, fp) within max_bits bits.

    fp values are distinct. The block keys carry the number of their key space, so a key is
    the pair (space, kept bits).
    """
    masks = block_masks(max_bits, blocks)
    spread = reps.select(
        "rep", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("space", "bits")
    )
    sizes = spread.groupBy("space", "bits").agg(F.count("*").alias("n"))
    hot = store(sizes.where(F.col("n") > tile), "hot-blocks")
    dealt = spread.join(maybe_broadcast(hot, 50_000), ["space", "bits"], "left")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("parts", parts).withColumn("mine", mine)
    # A row of chunk c goes to the tiles {c, j} for every chunk j of its key.
    tiles = dealt.select(
        "space", "bits", "rep", "fp", "parts", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("space", "bits", (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).alias("cell"), "fp", "rep")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        tiles.repartition(n, "space", "bits", "cell")
        .sortWithinPartitions("space", "bits", "cell")
        .mapInArrow(_tile_links(max_bits), "a long, b long")
    )


def simhash_dedup(docs: DataFrame, max_bits: int = 3, blocks: int = 5, shingle: int = 3, tile: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null and empty texts have fingerprint zero and link with each other. Rows that repeat a
    doc_id each get a row. A row without doc_id has a fingerprint and no component. Columns
    other than doc_id and text are ignored.
    """
    fps = store(fingerprints(docs, shingle), "simhash")
    reps = fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # A repeated doc_id with two texts ties their fingerprints together, as one node.
    split_ids = fps.where(F.col("doc_id").isNotNull()).distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    ties = fps.join(split_ids, "doc_id", "left_semi").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = hamming_links(reps, max_bits, blocks, tile).unionByName(ties)
    comps = connected_components(links)
    classes = reps.join(comps, reps["rep"] == comps["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(classes, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate component, and rows without doc_id."""
    kept = simhash_dedup(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
