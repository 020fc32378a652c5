"""SpotSigs document fingerprints.

A signature is a common word (the anchor) and the chain of the content words that follow it.
A document's fingerprint is its set of signatures, kept as sorted 64-bit hashes. Sets are
compared by Jaccard likeness; the ratio of two set lengths bounds it from above, so sets are
partitioned by length, and a set is listed under a few of its signatures only, the rare ones
first: two sets that are alike enough share one of these.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.alike import alike_components, likeness
from orefall.llm.common import STORED, deal_by_range, delete_stored, shuffle_partitions, store
from orefall.llm.ranges import Ranges, spread_texts

# Common words of English, German, French and Spanish that anchor signatures.
ANCHORS = frozenset(
    w.encode()
    for w in (
        "a an and are as at be by for from in is it of on or that the this to was which with "
        "das dem den der des die ein eine für ist mit und von zu "
        "au aux de des du en est et la le les pour que qui un une "
        "con del el en es las los no para por se su una y"
    ).split()
)
CHAIN = 3
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the signatures of a whole text.

    The start of a text counts as an anchor too, so that each text with a content word has
    a signature; near the end a chain may be shorter than ``chain``. A text without content
    words is signed by its anchors in a row, one without words by its bytes, an empty one
    not at all.
    """
    import xxhash

    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().translate(_BLANKED).split()
    content: list[bytes] = []
    anchors: list[tuple[bytes, int]] = [(b"^", 0)]
    add, mark, known = content.append, anchors.append, ANCHORS
    for w in words:
        if w in known:
            mark((w, len(content)))
        else:
            add(w)
    if not content:
        left = b" ".join(words) or raw
        return np.array([xxhash.xxh64_intdigest(left)] if left else [], dtype=np.uint64)
    digest, n = xxhash.xxh64_intdigest, len(content)
    spots = {a + b" " + b" ".join(content[k : k + chain]) for a, k in anchors if k < n}
    return np.unique(np.array([digest(s) for s in spots], dtype=np.uint64))


def to_string(sigs: np.ndarray) -> str:
    """The set as text: base64 of little-endian 64-bit hashes in ascending order."""
    return base64.b64encode(sigs.astype("<u8").tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u8")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_signatures) for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [signatures(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(to_string, sets), pa.string()), pa.array([len(s) for s in sets], pa.int32())], names=["doc_id", "fingerprint", "n_signatures"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string, n_signatures int")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"


def edited_fingerprints(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, and its component among all.

    Documents stand in descending doc_id (nulls last; equal ids by their packed text), after
    the last comes the first. The edited text has its last third replaced by as many code
    points from the start of the next document, or all it has. Null and empty texts have the
    empty fingerprint; a row without doc_id has no component_id, which else is that of
    ``spotsigs_dedup``. Columns other than doc_id and text are ignored; an empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        last: tuple | None = None
        known: tuple | None = None
        rows: list[tuple] = []

        def pair(doc_id, text: str, sigs: np.ndarray, component, next_text: str, next_sigs: np.ndarray) -> None:
            cut = len(text) // 3
            edited = text[: len(text) - cut] + next_text[:cut]
            new = sigs if edited == text else signatures(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc_id, len(text), digest, to_string(sigs), to_string(new), likeness(sigs, new), likeness(sigs, next_sigs), component))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in EDITS.split(", ")])

        ended = False
        for b in batches:
            for halo, doc_id, kind, packed in zip(*(b.column(c).to_pylist() for c in ("halo", "doc_id", "kind", "payload")), strict=True):
                if ended:
                    continue
                if not kind:
                    known = (doc_id, int.from_bytes(packed, "little", signed=True))
                    continue
                text = unzip.decompress(packed).decode("utf-8", "surrogatepass")
                sigs = signatures(text)
                if last is not None:
                    pair(*last, text, sigs)
                component = known[1] if known is not None and known[0] == doc_id else doc_id
                last, ended = (None, True) if halo else ((doc_id, text, sigs, component), False)
                if len(rows) >= 512:
                    yield flush()
        if rows:
            yield flush()

    ranges = Ranges.of(docs, halo=True)
    before = len(STORED)
    classes = store(spotsigs_dedup(docs, at_least).where("component_id <> doc_id"), "spotsigs-classes")
    delete_stored(docs.sparkSession, before, len(STORED) - 1)  # all that led to the classes, before the texts are dealt

    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [x.to_bytes(8, "little", signed=True) for x in b.column("component_id").to_pylist()]
            part = deal_by_range(ranges.bounds, b.column("doc_id"))
            zero = pa.array(np.zeros(len(part), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part), zero, b.column("doc_id"), zero, pa.array(marks, pa.binary())], names=["part", "halo", "doc_id", "kind", "payload"])

    texts = spread_texts(docs, ranges, halo=True).select("part", "halo", "doc_id", F.lit(1).alias("kind"), "payload")
    both = texts.unionByName(classes.mapInArrow(noted, "part int, halo int, doc_id long, kind int, payload binary"))
    return ranges.deal(both).sortWithinPartitions("halo", F.col("doc_id").desc_nulls_last(), "kind", "payload").mapInArrow(run, EDITS)


COMMON_OF, COMMON_LEAST, COMMON_MOST = 1024, 3, 200_000


def common_signatures(docs: DataFrame, most: int = COMMON_MOST) -> np.ndarray:
    """Sorted hashes of signatures that are common in many runs of documents, ``most`` at most.

    Each run of COMMON_OF documents reports those that COMMON_LEAST of them have. All
    documents are looked at. Only the order in which sets are listed hangs on this, no link does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, COMMON_OF):
                sets = [signatures(t) for t in b.column("text").slice(at, COMMON_OF).to_pylist() if t]
                found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
                often = counts >= COMMON_LEAST
                yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often])], names=["sig", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "sig").limit(most).select("sig").toArrow().column("sig").to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def listed_under(sigs: np.ndarray, common: np.ndarray, at_least: float) -> np.ndarray:
    """The signatures that a set is listed under, ascending: its first n - ceil(at_least * n) + 1, common ones last.

    For that order a signature loses its lowest bit, and common ones get the highest.
    """
    order = np.unique((sigs >> np.uint64(1)) | (np.isin(sigs, common, assume_unique=True).astype(np.uint64) << np.uint64(63)))
    return order[: len(sigs) - math.ceil(at_least * len(sigs) - 1e-9) + 1 if len(sigs) else 0]


def some_reach(values: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether one of values[start:end] is ``least`` or more, for each range; by maxima of runs whose length doubles."""
    found, length, span = np.zeros(len(start), bool), end - start, 1
    top = int(length.max(initial=0))
    while span <= top:
        ask = np.flatnonzero((length >= span) & (length < 2 * span))
        found[ask] = np.maximum(values[start[ask]], values[end[ask] - span]) >= least[ask]
        values = np.maximum(values[:-span], values[span:])
        span *= 2
    return found


def partners(key: np.ndarray, n: np.ndarray, place: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, band) of the rows that have a partner under their key in a length partition, for rows in the order of whole keys.

    ``place`` is the number of members before the key in the common order. In the first bucket
    that two sets share, all before it is in one of them only, so they have n - place members in
    common at most, and by that may be alike or not. Each pair that is alike stays in that bucket.
    """
    same = np.flatnonzero(key[1:] == key[:-1])
    rows = np.unique(np.r_[same, same + 1])
    part = np.floor(np.log(n[rows]) / math.log(1 / at_least)).astype(np.int32)
    rows, band = np.r_[rows, rows], np.r_[part, part + 1]
    order = np.lexsort((n[rows], band, key[rows]))
    rows, band = rows[order], band[order]
    if not len(rows):
        return rows, band
    size, k = n[rows].astype(np.int64), key[rows]
    most = ((size - place[rows]) * (1 + at_least) / at_least - size + 1e-6).clip(0, 2**31)
    new = np.r_[True, (k[1:] != k[:-1]) | (band[1:] != band[:-1])]
    group = np.cumsum(new) - 1
    at = np.arange(len(rows))
    end = np.searchsorted((group << 32) + size, (group << 32) + np.floor(most).astype(np.int64), side="right")
    met = some_reach(most, np.flatnonzero(new)[group], np.minimum(at, end), size) | some_reach(most, at + 1, end, size)
    return rows[met], band[met]


def _met(at_least: float):
    """Streams rows (key, rep, n, place) sorted by key; puts out (rep, key, band) where there are partners."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, rep, n, place = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("key", "rep", "n", "place"))
        rows, band = partners(key, n, place, at_least)
        return pa.RecordBatch.from_arrays([pa.array(rep[rows]), pa.array(key[rows]), pa.array(band)], names=["rep", "key", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield found([*held, b.slice(0, last)])
                held = []
            held.append(b.slice(last))
        if held:
            yield found(held)

    return run


def spotsigs_dedup(docs: DataFrame, at_least: float = 0.8, tile: int = 128) -> DataFrame:
    """(doc_id, component_id) for each doc_id: documents whose signature sets have a Jaccard likeness of ``at_least`` link, links chain.

    Equal sets are folded first. Two sets that are alike enough share one of the signatures
    that they are listed under, and their lengths lie in the same or neighbouring partitions,
    so each is listed in its own partition and the next, where its place in the common order
    leaves it a partner (``partners``). Signatures that list one set alone are dropped before any set is moved. No pair is lost and none is put out, only spanning
    links. Texts without words of any kind share the empty set; rows without doc_id are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    shared = spark.sparkContext.broadcast(common_signatures(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [signatures(t or "") for t in b.column("text").to_pylist()]
            keys = [listed_under(s, shared.value, at_least).view(np.int64) for s in sets]
            cols = [b.column("doc_id"), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "n", "sigs"])

    seen = store(docs.mapInArrow(run, "doc_id long, digest binary, n int, sigs array<long>"), "spotsigs")
    reps = store(seen.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sigs").alias("sigs")), "spotsigs-sets")
    listed = reps.select("rep", "n", F.posexplode("sigs").alias("place", "key")).select("key", "rep", "n", "place")
    listed = listed.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    banded = store(listed.mapInArrow(_met(at_least), "rep long, key long, band int"), "spotsigs-listed")
    # The upper halves keep the order.
    firsts = reps.select("rep", "n", F.transform("sigs", lambda x: F.shiftright(x, 32).cast("int")).alias("firsts"))
    return alike_components(docs, seen, reps, banded, signatures_or_none, at_least, tile, firsts=firsts, spent=(seen, reps, banded))


def signatures_or_none(text: str | None) -> np.ndarray:
    return signatures(text or "")
