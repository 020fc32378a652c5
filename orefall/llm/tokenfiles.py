"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on doc_id.

Texts are dealt to ascending ranges of doc_id, sorted, encoded and written, one file for each
range. ORC's own statistics and Bloom filters then let a reader take stripes in parallel and
skip those that cannot hold a wanted document.

Encoding is by the tokenizers library. Texts are cut only where this pre-tokenizer always
cuts, so that an encoded piece can be kept and used again; a bounded store of pieces stays
with the worker.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefall.llm.common import give_back, maybe_broadcast, shared_dir
from orefall.llm.ranges import dealt_texts

END_ID = 2
KEEP_PIECES = 300_000
FILE_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"

class Encoder:
    """A tokenizer and the pieces it has encoded, in two generations: what is not used while the new one fills up goes."""

    def __init__(self, path: str, plain: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in self.special for c in t):
            raise ValueError("an added token holds white space, where texts are cut")
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fresh(self) -> dict[str, bytes]:
        if len(self.kept) > KEEP_PIECES:
            self.old, self.kept = self.kept, {}
        self.kept[""] = b""
        return self.kept


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, plain: bool) -> Encoder:
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]


MARK = "\x01"


def safe_pieces(text: str) -> list[str]:
    """Cuts ``text`` where this pre-tokenizer always cuts; joined, the pieces are the text.

    Where each blank or line feed stands alone between other characters, there is a cut
    before each blank and on both sides of each line feed. Other texts are cut only before
    blanks that stand alone.
    """
    if MARK not in text:
        pieces = text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split(MARK)
        # Nothing else is white space, and no two of them stand together or at an end.
        if sum(map(len, text.split())) == len(text) - text.count(" ") - text.count("\n") and "" not in pieces and " " not in pieces:
            return pieces
    pieces = text.split(" ")
    for i in range(1, len(pieces)):
        pieces[i] = " " + pieces[i]
    out: list[str] = []
    glue = True
    for p in pieces:
        # The blank that starts p is a safe cut if p goes on with a non-blank and what stands before ends with one.
        if out and (glue or p[1:2].isspace() or len(p) == 1):
            out[-1] += p
        else:
            out.append(p)
        glue = not out[-1] or out[-1][-1].isspace()
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()
_BLANK = _LETTERS[32]


def _packed(pieces: list[str], path: str, plain_specials: bool) -> list[bytes]:
    """Packed uint32 ids of each distinct piece, through the worker's store.

    A word of letters only, with or without a blank before it, is one pre-token and goes
    straight to the tokenizer's model. Others without white space inside are encoded many at
    a time, parted by line feeds, which are tokens of their own. A piece with the string of an
    added token goes alone, since white space beside that token is cut in another way.
    """
    encoder = _encoder(path, plain_specials)
    special = encoder.special
    tokenizer, feed, kept, old = encoder.tokenizer, encoder.feed, encoder.fresh(), encoder.old
    found = list(map(kept.get, pieces))
    spots = [i for i, ids in enumerate(found) if ids is None]
    missing = []
    for i in spots:
        p = pieces[i]
        if p in old:
            kept[p] = old[p]
        else:
            missing.append(p)
    whole, plain, rest = tokenizer.model.tokenize, [], []
    for p in missing:
        if (p[1:] if p[0] == " " else p).isalpha():
            word = (_BLANK + p[1:] if p[0] == " " else p) if p.isascii() else p.encode("utf-8").decode("latin-1").translate(_LETTERS)
            kept[p] = array("I", [t.id for t in whole(word)]).tobytes()
        elif any(t in p for t in special):
            rest.append(p)
        elif len(p.split()) == 1 and not p[-1].isspace() and not p[1:2].isspace() and (p[0] == " " or not p[0].isspace()):
            plain.append(p)
        else:
            rest.append(p)
    for at in range(0, len(plain), 200):
        part = plain[at : at + 200]
        ids = np.array(tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cuts = np.flatnonzero(ids == feed)
        if len(cuts) != len(part) - 1:
            raise ValueError("a piece holds a line feed token")
        for q, lo, hi in zip(part, np.r_[0, cuts + 1], np.r_[cuts, len(ids)], strict=True):
            kept[q] = ids[lo:hi].tobytes()
    for q in rest:
        kept[q] = np.array(tokenizer.encode(q, add_special_tokens=False).ids, dtype=np.uint32).tobytes()
    for i in spots:
        found[i] = kept[pieces[i]]
    return found


def encode_texts(texts: list[str], path: str, plain_specials: bool = True) -> list[np.ndarray]:
    """Token ids of each text as uint32 arrays, equal to the library's for the whole text.

    Strings of special tokens in a text are ordinary text, or, without ``plain_specials``,
    those tokens, as in the library by default.
    """
    split = [safe_pieces(t) if t else [] for t in texts]
    distinct = list(set().union(*split))
    table = dict(zip(distinct, _packed(distinct, path, plain_specials), strict=True))
    return [np.frombuffer(b"".join([table[p] for p in s]), dtype=np.uint32) for s in split]


# Punctuation between a letter or digit and white space: a pre-token of its own, so words are met without it.
_TAIL = r"([\p{L}\p{N}])([.,;:!?]+)([ \n]|$)"
# Texts that need the careful cut: white space other than blank and line feed, two together or one at an end, or a mark of ours.
_CAREFUL = r"[\x01\x02\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"


def encode_column(texts: pa.Array, path: str, plain_specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids in each text) for a string column without nulls.

    The column is cut to pieces and these are made distinct by Arrow; Python sees each
    distinct piece of the batch once, and Arrow gathers the ids.
    """
    careful = pc.match_substring_regex(texts, _CAREFUL)
    slow = np.flatnonzero(careful.to_numpy(zero_copy_only=False))
    whole: dict[str, bytes] = {}
    if len(slow):
        texts = texts.to_pylist()
        for i, ids in zip(slow, encode_texts([texts[i] for i in slow], path, plain_specials), strict=True):
            whole[f"\x02{i}"] = ids.tobytes()
            texts[i] = f"\x02{i}"
        texts = pa.array(texts, pa.string())
    parted = pc.replace_substring_regex(texts, _TAIL, "\\1\x01\\2\\3")
    marked = pc.replace_substring(pc.replace_substring(parted, "\n", "\x01\n\x01"), " ", "\x01 ")
    lists = pc.split_pattern(marked, MARK)
    coded = lists.flatten().dictionary_encode()
    pieces = coded.dictionary.to_pylist()
    packed = _packed([p for p in pieces if p not in whole] if whole else pieces, path, plain_specials)
    if whole:
        rest = iter(packed)
        packed = [whole[p] if p in whole else next(rest) for p in pieces]
    sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
    table = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype=np.uint32)))
    values = table.take(coded.indices).flatten().to_numpy()
    before = np.r_[0, np.cumsum(sizes[coded.indices.to_numpy()])]
    return values, np.diff(before[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def _portions(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("payload")).to_numpy())
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Write the token ids of ``docs`` (doc_id, text) as ORC under ``out``, in ascending doc_id order over the files.

    Null texts count as empty and get the end id alone; null ids come first; rows that
    repeat an id stay beside each other. An empty table gives files without rows. The
    string of a special token in a text gives that token, as in the library by default.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for b in batches:
            for part in _portions(b):
                values, counts = encode_column(part.column("payload").cast(pa.string()), tokenizer_path, plain_specials=False)
                counts += 1
                ends = np.cumsum(counts)
                flat = np.full(len(values) + len(counts), end_id, dtype=np.int32)
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = values
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column("part"), part.column("doc_id"), pa.array(start + ends - counts), pa.array(counts), lists],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])
                del values, flat, inner, lists
                give_back()

    dealt = dealt_texts(docs, parts=parts, pack=False).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "payload")
    (
        dealt.mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.compression.zstd.level", "1")  # packed ids hardly shrink at higher levels
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "2000")
        .option("orc.stripe.size", str(32 << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(out)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before, over all files."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return files.join(maybe_broadcast(before, 1_000_000), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id: the filter reaches ORC, whose statistics and Bloom filters skip stripes and row groups."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def ids_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            offsets = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crcs = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> str:
    """Write ``docs`` to a new folder among the shared ones; returns its path."""
    out = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(docs, out, tokenizer_path)
    return out
