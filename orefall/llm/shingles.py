"""Near-duplicates by Jaccard likeness of word shingles: SimHash and MinHash propose, exact sets decide.

The pigeonhole blocks of the SimHash operator propose pairs whose fingerprints differ in a few
bits. SimHash alone cannot reach a likeness of 0.8: such pairs differ in about 10 of 64 bits,
often in 15, and no pigeonhole of that many bits has keys wide enough. So two texts are also
candidates if all ``rows`` minima of one of ``bands`` bands agree (likeness 0.8 with 24 bands
of 5: all but 1 pair in 14,000). Candidates link if their sets of shingles, 64-bit hashes
each, are alike enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.alike import alike_components
from orefall.llm.common import store
from orefall.llm.simhash import hamming_links, simhash_of

_RNG = np.random.default_rng(29)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles: A-Z lower-cased, words split at ASCII blanks; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - shingle + 1
    h = np.zeros(n, np.uint64)
    for k in range(shingle):
        h += w[k : k + n] * _PLACE[k]
    return np.unique(_mixed(h))


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(31)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key of each band from the minima of bands * rows permutations; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    times, plus = _permutations(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * times + plus).min(axis=0))
    keys = (_mixed(least).reshape(bands, rows) * _PLACE[:rows]).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64)


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, fp, keys): digest of the whole set, its SimHash fingerprint, keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            digests, fps, keys = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, shingle)
                digests.append(xxhash.xxh128_digest(s.tobytes()))
                fps.append(simhash_of(s))
                keys.append(band_keys(s, bands, rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, digest binary, fp long, keys array<long>")


def simhash_pairs(reps: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """(centre, rep): spanning pairs of ``reps`` (rep, fp) whose fingerprints differ in at most ``max_bits`` bits."""
    classes = store(reps.groupBy("fp").agg(F.min("rep").alias("centre")), "simhash-classes")
    same = reps.select("rep", "fp").join(classes, "fp").where("rep <> centre").select("centre", "rep")
    close = hamming_links(classes.select(F.col("centre").alias("rep"), "fp"), max_bits, blocks)
    return store(same.unionByName(close.select(F.col("b").alias("centre"), F.col("a").alias("rep"))), "simhash-pairs")


def shingle_components(docs: DataFrame, shingle: int = 5, at_least: float = 0.8, max_bits: int = 3, blocks: int = 5, bands: int = 24, rows: int = 5, tile: int = 128) -> DataFrame:
    """(doc_id, component_id) for each doc_id of ``docs``: likeness of ``at_least`` links, links chain.

    Null and empty texts have the empty set and link with each other. A doc_id with several
    texts ties them together. Rows without doc_id and columns other than doc_id and text are
    ignored; an empty table gives an empty result.
    """
    seen = store(sketches(docs.where("doc_id IS NOT NULL"), shingle, bands, rows), "sketches")
    reps = store(seen.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "shingle-sets")
    banded = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    return alike_components(docs, seen, reps, banded, partial(shingle_set, shingle=shingle), at_least, tile, simhash_pairs(reps, max_bits, blocks))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate component, and rows without doc_id."""
    kept = shingle_components(docs, **options).where("doc_id = component_id").select("doc_id")
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
