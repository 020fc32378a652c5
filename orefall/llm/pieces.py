"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units at places that no piece of the vocabulary spans. For the distinct
units, substrings of bounded length are exploded and equi-joined to the piece table; what
matches are the edges of a unit's lattice. Edges are grouped by unit and folded with Spark's
higher-order ``aggregate``.

The public model is of the BPE kind: its scores are merge ranks, not log probabilities, and
the path with the best sum of scores is not what the model's own encoder gives. The fold
therefore walks the lattice's edges in the order of rank and place and joins two neighbouring
segments wherever an edge spans exactly these two; what is left at the end is the model's own
segmentation, as long as each piece is made of two segments that better pieces leave of it
(``Vocabulary.consistent``). Characters without a piece become byte pieces.

The encoded units go back to the texts by chunk: a chunk is a run of documents of one input
split with about ``CHUNK_BYTES`` of text at most, and needs only the units that it holds. Both
passes over the texts see the same splits, since texts that are not simply read from files are
written first; a chunk whose units differ all the same stops the job.

A unit of more than ``BITS`` characters (a run of one letter, of blanks) is folded where its
chunk is encoded, over the same edges in the same order, in time and memory in proportion to
its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.llm.common import give_back, replayable, shuffle_partitions

SPACE = "▁"
CHUNK_BYTES = 12 << 20
PACK_BYTES = 1 << 20
WINDOW_BYTES = 1 << 20
BITS = 62  # the boundaries of a unit up to this length are the bits of one long
EDGES = 4 << 20  # edges of a long unit that are sorted at a time

# Rolling hashes modulo 2^64: an odd base has an inverse, so that the hash of any span comes from two prefix sums.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _spread(points: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Spans:
    """Hashes of any spans of a run of code points."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_spread(points) * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_BASE_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def _points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")


class Vocabulary:
    """The normal pieces of a model file with their ids, the byte pieces, and what pieces span."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in normal}
        ranked = sorted(self.ids.values(), key=lambda i: (-model.get_score(i), i))
        self.rank = {i: r for r, i in enumerate(ranked)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        if self.longest >= BITS or len(ranked) << EDGE_SHIFT >= 1 << 31:
            raise ValueError("an edge of this vocabulary does not fit an int")
        self.pieces = [b""] * n
        for p, i in self.ids.items():
            self.pieces[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.pieces[i] = bytes([b])
        self.piece_bytes = pa.array(self.pieces, pa.large_binary())
        self._tables()

    def _tables(self) -> None:
        """Characters within pieces are numbered from 1, and ``spanned`` tells for two such numbers whether a piece holds them in a row."""
        letters = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.width = len(letters) + 1
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.width)
        self.spanned = np.zeros(self.width * self.width, bool)
        for p in self.ids:
            k = self.letter[[ord(c) for c in p]]
            self.spanned[k[:-1] * self.width + k[1:]] = True
        self.one = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.one[ord(p)] = i
        longer = [p for p in self.ids if len(p) > 1]
        points = np.zeros((len(longer), self.longest), np.uint32)
        keys = np.zeros(len(longer), np.uint64)
        for row, p in enumerate(longer):
            points[row, : len(p)] = [ord(c) for c in p]
            keys[row] = Spans(points[row, : len(p)]).of(np.array([0]), np.array([len(p)]))[0]
        order = np.argsort(keys)
        self.keys, self.key_points = keys[order], points[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces of this vocabulary share a hash")
        self.key_ids = np.array([self.ids[longer[r]] for r in order], np.int32)
        self.key_ranks = np.array([self.rank[self.ids[longer[r]]] for r in order], np.int32)

    def consistent(self) -> bool:
        """Whether the better pieces leave just two segments of each piece, so that one walk over the edges in order does."""
        return all(len(self.fold(_points(p.encode()), self.rank[i])) == 1 for p, i in self.ids.items() if len(p) > 1)

    def cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Byte offsets where units of marked texts begin: where a text begins, and wherever no piece spans the two characters beside.

        Windows of bounded size, so a long text takes a few bytes a byte.
        """
        out, last, at, n = [], 0, 0, len(raw)
        while at < n:
            end = min(n, at + WINDOW_BYTES)
            while end < n and raw[end] & 0xC0 == 0x80:
                end += 1
            part = raw[at:end]
            begins = np.flatnonzero((part & 0xC0) != 0x80)
            k = self.letter[_points(part.tobytes())]
            before = np.r_[last, k[:-1]]
            out.append(begins[~self.spanned[before * self.width + k]] + at)
            last, at = k[-1], end
        found = np.concatenate(out) if out else np.zeros(0, np.int64)
        starts = np.unique(starts[starts < n])
        spots = np.searchsorted(found, starts)
        lacking = (spots == len(found)) | (found[np.minimum(spots, len(found) - 1)] != starts) if len(found) else np.ones(len(starts), bool)
        return np.insert(found, spots[lacking], starts[lacking])

    def fold(self, points: np.ndarray, worst: int | None = None) -> np.ndarray:
        """Where the segments of a unit of any length begin; only edges of rank ``worst`` or better, if given."""
        n, spans, ranks, lengths = len(points), Spans(points), [], []
        for length in range(2, min(self.longest, n) + 1):
            starts = np.arange(n - length + 1)
            keys = spans.of(starts, starts + length)
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hits = np.flatnonzero(self.keys[found] == keys)
            rows = found[hits]
            same = np.ones(len(hits), bool)
            for k in range(self.longest):
                same &= self.key_points[rows, k] == (points[hits + k] if k < length else 0)
            hits, rows = hits[same], rows[same]
            if len(hits):
                r = np.full(n, -1, np.int32)
                r[hits] = self.key_ranks[rows]
                ranks.append(r)
                lengths.append(length)
        after = array("q", range(1, n + 1))
        if ranks:
            seen, counts = np.unique(np.concatenate([r[r >= 0] for r in ranks]), return_counts=True)
            seen = seen if worst is None else seen[seen <= worst]
            blocks = np.cumsum(counts[: len(seen)]) // EDGES
            for b in np.unique(blocks):
                lo, hi = seen[blocks == b][[0, -1]]
                spots = [np.flatnonzero((r >= lo) & (r <= hi)) for r in ranks]
                s = np.concatenate(spots)
                e = s + np.repeat(lengths, [len(x) for x in spots])
                order = np.lexsort((s, np.concatenate([r[x] for r, x in zip(ranks, spots, strict=True)])))
                for a in range(0, len(order), 1 << 16):
                    some = order[a : a + (1 << 16)]
                    for start, end in zip(s[some].tolist(), e[some].tolist(), strict=True):
                        middle = after[start]
                        if 0 < middle < end and after[middle] == end:
                            after[start] = end
                            after[middle] = 0
        return np.flatnonzero(np.frombuffer(after, np.int64))

    def fill(self, units: pa.Array, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each unit): units up to BITS characters by the bits of their mask (0: each character alone), longer ones folded here."""
        sizes = pc.utf8_length(units).to_numpy().astype(np.int64)
        points = _points(b"".join(units.cast(pa.binary()).to_pylist()))
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(points)) - np.repeat(first, sizes)
        mask = np.repeat(masks, sizes)
        begins = (mask == 0) | ((mask >> np.minimum(place, 63)) & 1 == 1)
        for u in np.flatnonzero(sizes > BITS).tolist():
            begins[first[u] : first[u] + sizes[u]] = False
            begins[first[u] + self.fold(points[first[u] : first[u] + sizes[u]])] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(points)]
        ids = self.one[points[starts]]
        several = np.flatnonzero(ends - starts > 1)
        keys = Spans(points).of(starts[several], ends[several])
        ids[several] = self.key_ids[np.searchsorted(self.keys, keys)]
        segments = np.add.reduceat(begins, first).astype(np.int64) if len(first) else first
        lacking = np.flatnonzero(ids < 0)
        if len(lacking):
            instead = [self._bytes_of(c) for c in points[starts[lacking]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[lacking] = list(map(len, instead))
            owner = np.repeat(np.arange(len(segments)), segments)
            segments = np.bincount(owner, times, len(segments)).astype(np.int64)
            at = np.cumsum(times) - times
            ids = np.repeat(ids, times)
            for i, got in zip(at[lacking].tolist(), instead, strict=True):
                ids[i : i + len(got)] = got
        return ids.astype("<u4"), segments

    def _bytes_of(self, point: int) -> list[int]:
        return [self.bytes[b] for b in chr(point).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """UTF-8 texts of the runs of ids between ``starts``: pieces joined, the blank that encoding puts first taken away."""
        joined = self.piece_bytes.take(pa.array(ids))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)[: len(ids) + 1]
        raw = joined.buffers()[2].to_pybytes() if len(ids) else b""
        return [raw[lo:hi].removeprefix(b" ") for lo, hi in zip(ends[starts], ends[np.r_[starts[1:], len(ids)]], strict=True)]


# An edge is one int: rank, start and 63 - length, so that the natural order is that of rank and
# place, and shifts, which take the low six bits of their amount, need no masking.
START_SHIFT, EDGE_SHIFT = 6, 12


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def split_units(vocab: Vocabulary, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct units in the order in which they appear, unit number of each unit in order, units of each text) for a string column without nulls.

    Blanks are marks, and a text that is not empty has a mark first, as the model sees it.
    """
    marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), "")
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", marked)
    offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
    raw = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(marked) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[:1]
    begins = vocab.cuts(raw, offsets[:-1])
    counts = np.diff(np.searchsorted(begins, offsets))
    ends = np.r_[begins, len(raw)].astype(np.int32)
    units = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = units.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts


def folded_in_sql(units: pa.Array) -> np.ndarray:
    """Positions of the units that have a lattice of their own: of two characters to BITS."""
    sizes = pc.utf8_length(units).to_numpy()
    return np.flatnonzero((sizes > 1) & (sizes <= BITS)).astype(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(chunk, ids, texts): consecutive rows with about CHUNK_BYTES of text, one row at least; the same cuts on each pass over the same split."""
    from pyspark import TaskContext

    chunk, size, held = TaskContext.get().partitionId() << 24, 0, []
    for b in batches:
        texts = b.column("text").fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, CHUNK_BYTES - size + before, side="right")))
            size += int(ends[stop - 1] - before)
            held.append((b.column("doc_id").slice(at, stop - at), texts.slice(at, stop - at)))
            if size >= CHUNK_BYTES or stop < b.num_rows:
                yield chunk, *map(pa.concat_arrays, zip(*held, strict=True))
                chunk, size, held = chunk + 1, 0, []
            at = stop
    if held:
        yield chunk, *map(pa.concat_arrays, zip(*held, strict=True))


def units_by_chunk(docs: DataFrame, path: str) -> DataFrame:
    """(chunk, pos, unit): the distinct units of each chunk of documents that a lattice is made for, with their position among all of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in _chunks(batches):
            units, *_ = split_units(vocabulary(path), texts)
            pos = folded_in_sql(units)
            for lo in range(0, len(pos), 50_000):
                part = pos[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part), units.take(pa.array(part))], names=["chunk", "pos", "unit"])
            del units
            give_back()

    return docs.mapInArrow(run, "chunk long not null, pos int not null, unit string not null")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, rank) of the pieces of two characters and more: a fixed vocabulary, so its size is bounded."""
    vocab = vocabulary(path)
    rows = [(p, vocab.rank[i]) for p, i in vocab.ids.items() if len(p) > 1]
    return spark.createDataFrame(pa.table({"piece": [p for p, _ in rows], "rank": pa.array([r for _, r in rows], pa.int32())}))


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(h1, h2, size, edges) from (h1, h2, unit): the edges of each unit's lattice in the order of rank and place.

    Units are known by two hashes, so that the rows of substrings hold no unit. Units without an edge have no row.
    """
    starts = units.select("h1", "h2", "unit", F.length("unit").alias("size")).select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 2)).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.col("size") - F.col("s")))).alias("n"))
    subs = spans.select("h1", "h2", "size", F.col("unit").substr(F.col("s") + 1, F.col("n")).alias("piece"), (F.col("s") * (1 << START_SHIFT) + 63 - F.col("n")).alias("span"))
    edges = subs.join(F.broadcast(pieces), "piece").select("h1", "h2", "size", (F.col("rank") * (1 << EDGE_SHIFT) + F.col("span")).alias("edge"))
    return edges.groupBy("h1", "h2").agg(F.min("size").alias("size"), F.array_sort(F.collect_list("edge")).alias("edges"))


def fold(edges: str, size: str) -> Column:
    """The boundaries that are left of a unit, as a mask with a bit for each.

    An edge joins two segments if its ends are boundaries and there is just one between: from its
    start to its end, shifted to the top, three bits are set, the first and the last among them.
    """
    seen = "shiftleft(shiftrightunsigned(m, shiftright(e, 6)), e)"
    joins = f"{seen} < 0 AND bit_count({seen}) = 3 AND (shiftrightunsigned(m, shiftright(e, 6)) & 1L) = 1L"
    inner = f"shiftleft(shiftrightunsigned({seen} & {(1 << 63) - 1}L, e) - 1L, shiftright(e, 6))"
    return F.expr(f"aggregate({edges}, shiftleft(1L, {size} + 1) - 1L, (m, e) -> if({joins}, m - {inner}, m))")


def best_paths(lattices: DataFrame) -> DataFrame:
    """(h1, h2, mask): the boundaries of the pieces of each unit."""
    return lattices.select("h1", "h2", fold("edges", "size").alias("mask"))


def _packed_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, seq, ids, payload): about PACK_BYTES of documents a row, their lengths and texts packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        for chunk, ids, texts in _chunks(batches):
            sizes = pc.binary_length(texts).to_numpy().astype(np.int32)
            ends = np.cumsum(sizes, dtype=np.int64)
            at, seq = 0, 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, PACK_BYTES + (ends[at - 1] if at else 0), side="right")))
                blob = sizes[at:stop].tobytes() + b"".join(texts.slice(at, stop - at).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([seq], pa.int32()), pa.array([ids.slice(at, stop - at).to_pylist()], pa.list_(pa.int64())), pa.array([zip_.compress(blob)], pa.binary())],
                    names=["chunk", "seq", "ids", "payload"],
                )
                at, seq = stop, seq + 1

    return docs.mapInArrow(run, "chunk long, seq int, ids array<long>, payload binary")


def _unpacked(packed: pa.Table) -> tuple[list, pa.Array]:
    """(ids, texts) of a chunk's packed rows."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    ids, texts = [], []
    for some, blob in zip(packed["ids"].to_pylist(), packed["payload"].to_pylist(), strict=True):
        raw = unzip.decompress(blob)
        sizes = np.frombuffer(raw, np.int32, len(some))
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        texts.append(pa.StringArray.from_buffers(len(some), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[4 * len(some) :])))
        ids += some
    return ids, pa.concat_arrays(texts)


ENCODED = "doc_id long, ids binary"


def _encode_chunk(vocab: Vocabulary, ids: list, texts: pa.Array, pos: np.ndarray, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ids of a chunk's documents from the boundaries of its units, which come by position."""
    units, order, counts = split_units(vocab, texts)
    wanted = folded_in_sql(units)
    sizes = pc.utf8_length(units.take(pa.array(wanted))).to_numpy()
    given = np.zeros(len(units), np.int64)
    given[pos[pos < len(units)]] = masks[pos < len(units)]
    whole = given[wanted]
    if not np.array_equal(np.sort(pos), wanted) or ((whole != 0) & (whole >> sizes != 1)).any():
        raise ValueError("the units of a chunk changed between two passes over the input")
    flat, sizes = vocab.fill(units, given)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
    stops = np.cumsum(counts)
    for lo in range(0, len(ids), 512):
        hi = min(len(ids), lo + 512)
        first, last = (stops[lo - 1] if lo else 0), stops[hi - 1]
        part = order[first:last]
        raw = lists.take(pa.array(part)).flatten().to_numpy().tobytes()
        ends = np.r_[0, np.cumsum(sizes[part])][np.r_[first, stops[lo:hi]] - first] * 4
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["doc_id", "ids"])


PACK_ROWS = 400_000


def _packed_units(known: DataFrame) -> DataFrame:
    """(chunk, n, payload): the units of a chunk that a task holds in one row, positions and masks packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        held: list[list] = [[], [], []]

        def out() -> pa.RecordBatch:
            chunk, pos, mask = map(np.concatenate, held)
            order = np.lexsort((pos, chunk))
            chunk, pos, mask = chunk[order], pos[order], mask[order]
            starts = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1]
            stops = np.r_[starts[1:], len(chunk)]
            blobs = [zip_.compress(pos[a:b].tobytes() + mask[a:b].tobytes()) for a, b in zip(starts, stops, strict=True)]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array((stops - starts).astype(np.int32)), pa.array(blobs, pa.binary())], names=["chunk", "n", "payload"])

        for b in batches:
            for x, name in zip(held, ("chunk", "pos", "mask"), strict=True):
                x.append(b.column(name).to_numpy(zero_copy_only=False))
            if sum(map(len, held[0])) >= PACK_ROWS:
                yield out()
        if sum(map(len, held[0])):
            yield out()

    return known.mapInArrow(run, "chunk long, n int, payload binary")


def _unpacked_units(packed: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(positions, masks) of the units of a chunk."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    pos, masks = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for n, blob in zip(packed["n"].to_pylist(), packed["payload"].to_pylist(), strict=True):
        raw = unzip.decompress(blob)
        pos.append(np.frombuffer(raw, np.int32, n))
        masks.append(np.frombuffer(raw, np.int64, n, 4 * n))
    return np.concatenate(pos), np.concatenate(masks)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for each row: ids as packed little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Rows that repeat a document each get a row. Columns
    other than doc_id and text are ignored; an empty table gives an empty result.
    """
    return _encoded(docs, path, lambda batch: batch, ENCODED)


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """``encoding_digest`` of ``encode``, taken where the ids are made so that they are not moved."""
    return _encoded(docs, path, lambda batch: _digest(batch, path), DIGEST)


def _encoded(docs: DataFrame, path: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows that ``finish`` makes of the batches of encoded documents."""
    docs = replayable(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "texts-to-encode")
    spark = docs.sparkSession
    first, second = F.xxhash64("unit"), F.xxhash64("unit", F.lit("second"))
    found = units_by_chunk(docs, path).repartition(shuffle_partitions(spark), first, second)
    # Conditions on aggregates stay above the shuffle and keep all its columns, so that both uses read one shuffle.
    distinct = found.select("chunk", "pos", "unit", first.alias("h1"), second.alias("h2")).groupBy("h1", "h2", "unit").agg(F.min("chunk").alias("chunk"), F.min("pos").alias("pos"))
    distinct = distinct.where("chunk >= 0 AND pos >= 0").select("h1", "h2", "unit")
    paths = best_paths(lattice(distinct, piece_table(spark, path), vocabulary(path).longest))
    known = found.select("chunk", "pos", first.alias("h1"), second.alias("h2")).join(paths.hint("merge"), ["h1", "h2"], "left").select("chunk", "pos", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))

    def solve(texts: pa.Table, units: pa.Table) -> pa.Table:
        empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["doc_id", "ids"])
        encoded = _encode_chunk(vocabulary(path), *_unpacked(texts.sort_by("seq")), *_unpacked_units(units)) if texts.num_rows else iter([empty])
        parts = list(map(finish, encoded))
        give_back()
        return pa.Table.from_batches(parts)

    # Each side has a shuffle of its own, so that the number of a split is the same in both passes.
    return _packed_chunks(docs).groupBy("chunk").cogroup(_packed_units(known).groupBy("chunk")).applyInArrow(solve, schema)


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, where each row's begin) of a column of packed ids."""
    raw = [i or b"" for i in column.to_pylist()]
    sizes = np.array([len(i) // 4 for i in raw], np.int64)
    return np.frombuffer(b"".join(raw), "<u4"), np.cumsum(sizes) - sizes


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encoded documents; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = [t.decode("utf-8", "replace") for t in vocabulary(path).decode(*_ids_of(b.column("ids")))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string"


def _digest(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    import hashlib

    raw = [i or b"" for i in batch.column("ids").to_pylist()]
    texts = vocabulary(path).decode(*_ids_of(batch.column("ids"))) if raw else []
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([len(i) // 4 for i in raw], pa.int64()), pa.array([zlib.crc32(i) for i in raw], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
        names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"],
    )


def encoding_digest(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256): the ids, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _digest(b, path)

    return encoded.select("doc_id", "ids").mapInArrow(run, DIGEST)
