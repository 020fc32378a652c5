"""Components of documents whose sets are alike, from buckets of candidates and exact Jaccard checks.

Equal sets are folded to one representative first. In each bucket all are compared with its
smallest id; only those that this leaves in other components are compared with the rest of
the bucket. Cells of bounded size hold these comparisons, so a large group of near copies
costs time in proportion to its size, and no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import drop_stored, maybe_broadcast, shuffle_partitions, store
from orefall.llm.components import connected_components

WANTED = 4_000_000  # ids of 8 bytes that go to the texts at once; beyond, the texts are shuffled to the ids
BUCKETS = 1_000_000  # buckets of 20 bytes, likewise
SetOf = Callable[[str | None], np.ndarray]


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 if the ratio of their lengths already rules out ``at_least``. Two empty sets: 1."""
    short, long_ = sorted((len(a), len(b)))
    if not long_:
        return 1.0
    if short < at_least * long_ - 1e-9 or not short:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (short + long_ - both)


def _verified(at_least: float, set_of: SetOf):
    """Streams rows sorted by cell; in each, probes are compared with all rows that are not in their component yet."""

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        sets = [set_of(r[3]) for r in rows]
        for i, (rep, label, probe, _) in enumerate(rows):
            for j, (other, its, *_) in enumerate(rows) if probe else ():
                if find(label) != find(its) and likeness(sets[i], sets[j], at_least) >= at_least:
                    up[find(label)] = find(its)
                    yield rep, other

    def links(rows: list[tuple]) -> pa.RecordBatch:
        found = list(solve(rows)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in batches:
            for band, key, cell, *row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if (band, key, cell) != held:
                    yield links(rows)
                    held, rows = (band, key, cell), []
                rows.append(tuple(row))
        yield links(rows)

    return run


def could_be_alike(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray, at_least: float) -> bool:
    """Whether two sets of ``n_a`` and ``n_b`` may have a likeness of ``at_least``, from marks of the first of each in a common order.

    Below the last that is known of both, a mark that only one of them has counts against
    them; sets that are alike enough differ in few. Members may share a mark, which rules out less.
    """
    if min(n_a, n_b) < at_least * max(n_a, n_b) - 1e-9:
        return False
    known = min([x[-1] for x, n in ((a, n_a), (b, n_b)) if len(x) < n], default=None)
    if known is not None:
        a, b = a[: np.searchsorted(a, known)], b[: np.searchsorted(b, known)]
    differ = len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True))
    return differ <= (n_a + n_b) * (1 - at_least) / (1 + at_least) + 1e-9


def _hopeful(at_least: float):
    """Streams rows sorted by cell; puts out those that may be alike with a probe of another component, or are such a probe.

    Where rows know all buckets that they are in, a pair counts in the first common one only.
    """

    def solve(rows: list[tuple]) -> list[tuple]:
        keep = [False] * len(rows)
        firsts = [np.unique(np.array(r[7], np.int32).view(np.uint32)) for r in rows]
        buckets = [None if r[9] is None else np.array(r[9], np.int64) for r in rows]

        def counts(i: int, j: int) -> bool:
            return buckets[i] is None or buckets[j] is None or np.intersect1d(buckets[i], buckets[j], assume_unique=True)[0] == rows[i][8]

        for i, row in enumerate(rows):
            for j, other in enumerate(rows) if row[5] else ():
                if row[4] != other[4] and not (keep[i] and keep[j]) and could_be_alike(row[6], firsts[i], other[6], firsts[j], at_least) and counts(i, j):
                    keep[i] = keep[j] = True
        return [r[:6] for r, k in zip(rows, keep, strict=True) if k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["band", "key", "cell", "rep", "label", "probe"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kept = solve(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], kind) for k, kind in enumerate(kinds)], names=names)

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield out(held)
                    held = []
                held.append(row)
        yield out(held)

    return run


ROWS = "band int, key long, cell int, rep long, label long, probe boolean"


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "band", "key", "cell").sortWithinPartitions("band", "key", "cell")


def packed_sets(set_of: SetOf):
    """Texts (rep, text) as their sets, packed: these are much smaller than texts where few words make a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [set_of(t).astype("<u8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.binary())], names=["rep", "content"])

    return run


def unpacked(content: bytes) -> np.ndarray:
    return np.frombuffer(content, dtype="<u8")


def _links(cells: DataFrame, contents_of: Callable[[DataFrame], DataFrame], at_least: float, set_of: SetOf, firsts: DataFrame | None) -> DataFrame:
    """Links (a, b) of cells (band, key, cell, rep, label, probe); with ``firsts``, rows that cannot be alike with any go before contents (texts or sets) are moved."""
    held = cells.groupBy("band", "key", "cell", "rep").agg(F.min("label").alias("label"), F.max("probe").alias("probe"))
    if firsts is not None:
        rows = held.join(firsts, "rep").select("band", "key", F.col("cell").cast("int").alias("cell"), "rep", "label", "probe", "n", "firsts", F.xxhash64("band", "key").alias("here"), "buckets")
        held = store(_by_cell(rows).mapInArrow(_hopeful(at_least), ROWS), "alike-hopeful")
    rows = held.join(contents_of(held), "rep").select("band", "key", "cell", "rep", "label", "probe", "content")
    return store(_by_cell(rows).mapInArrow(_verified(at_least, set_of), "a long, b long"), "alike-links")


def alike_components(docs: DataFrame, seen: DataFrame, reps: DataFrame, banded: DataFrame, set_of: SetOf, at_least: float, tile: int = 128, near: DataFrame | None = None, firsts: DataFrame | None = None, spent: Sequence[DataFrame] = ()) -> DataFrame:
    """(doc_id, component_id) for each doc_id of ``docs``: sets with a likeness of ``at_least`` link, links chain.

    ``seen`` has (doc_id, digest of the set), ``reps`` (digest, rep) the smallest id of each
    digest, ``banded`` (band, key, rep) the buckets in which candidates meet, ``near`` more
    candidates (centre, rep). ``set_of`` gives the sorted set of a text. ``firsts`` (rep, n,
    firsts) may hold the size of each set and marks of its first members in any common order:
    ints that do not descend, taken without sign; then sets are moved in place of texts. ``spent`` are stored tables
    behind these that nothing else reads: they are deleted before any set is compared. Null and empty texts link with
    each other. A doc_id with several texts ties them together.
    """
    spark = docs.sparkSession
    ties = seen.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    ids = seen.select("doc_id").distinct()
    if spent:
        ties = store(ties, "alike-ties")
        ids = ties.select(F.col("a").alias("doc_id")).distinct()
    sizes = banded.groupBy("band", "key").agg(
        F.count("*").alias("m"), F.min("rep").alias("centre"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")
    )
    # Buckets of the same members count once.
    once = sizes.where("m > 1").groupBy("m", "x", "y").agg(F.min(F.struct("band", "key", "centre")).alias("s"))
    buckets = store(once.select("s.band", "s.key", "s.centre"), "alike-buckets")
    members = store(banded.join(maybe_broadcast(buckets, BUCKETS), ["band", "key"]).select("band", "key", "centre", "rep"), "alike-members")
    if firsts is not None:
        met = store(members.select("rep").distinct(), "alike-wanted")
        firsts = store(firsts.join(maybe_broadcast(met, WANTED), "rep", "left_semi"), "alike-firsts")
    for table in spent:
        drop_stored(table)
    near = spark.createDataFrame([], "centre long, rep long") if near is None else near
    every = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    def texts_of(rows: DataFrame) -> DataFrame:
        wanted = store(rows.select("rep").distinct(), "alike-wanted")
        return every.join(maybe_broadcast(wanted, WANTED), "rep", "left_semi")

    def sets_of(rows: DataFrame) -> DataFrame:
        # Dealt by rep, so that the join behind needs no second shuffle.
        sets = texts_of(rows).mapInArrow(packed_sets(set_of), "rep long, content binary")
        return sets.repartition(shuffle_partitions(spark), "rep").dropDuplicates(["rep", "content"])

    if firsts is None:
        texts = texts_of(members.select("rep").unionByName(near.select("rep")).unionByName(near.select(F.col("centre").alias("rep"))))
        texts = store(texts.dropDuplicates(["rep", "text"]), "alike-texts").withColumnRenamed("text", "content")
        contents_of, compared = (lambda _: texts), set_of
    else:
        contents_of, compared = sets_of, unpacked

    # Each member against the smallest of its bucket.
    pairs = store(members.select("centre", "rep").unionByName(near.select("centre", "rep")).where("rep <> centre").distinct(), "alike-pairs")
    hot = store(pairs.groupBy("centre").agg(F.count("*").alias("m")).where(F.col("m") > tile), "hot-centres")
    dealt = pairs.join(maybe_broadcast(hot, 50_000), "centre", "left").withColumn("parts", F.ceil(F.coalesce("m", F.lit(1)) / tile).cast("int"))
    dealt = dealt.select(F.lit(0).alias("band"), F.col("centre").alias("key"), F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("cell"), "rep", "centre")
    cells = dealt.select("band", "key", "cell", "rep", F.col("rep").alias("label"), F.lit(False).alias("probe")).unionByName(
        dealt.select("band", "key", "cell", "centre").distinct().select("band", "key", "cell", F.col("centre").alias("rep"), F.col("centre").alias("label"), F.lit(True).alias("probe"))
    )
    links = _links(cells, contents_of, at_least, compared, None if firsts is None else firsts.withColumn("buckets", F.lit(None).cast("array<long>"))).unionByName(ties)

    # Those in other components than it, against all of the bucket.
    comps = store(connected_components(links), "alike-components")
    main = buckets.join(comps, buckets["centre"] == comps["node"], "left").select("band", "key", F.coalesce("component", "centre").alias("main"))
    labelled = members.join(comps, members["rep"] == comps["node"], "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("label"))
    labelled = store(labelled.join(main, ["band", "key"]).withColumn("probe", F.col("label") != F.col("main")), "alike-members")
    open_ = labelled.groupBy("band", "key").agg(F.count("*").alias("m"), F.count_if("probe").alias("f")).where("f > 0")
    part = F.pmod(F.xxhash64("rep"), "parts").cast("int")
    probe_part = F.pmod(F.xxhash64("rep"), "probe_parts").cast("int")
    left = store(
        labelled.join(open_, ["band", "key"])
        .withColumn("parts", F.ceil(F.col("m") / tile).cast("int")).withColumn("probe_parts", F.ceil(F.col("f") / tile).cast("int"))
        .select("band", "key", "rep", "label", "probe", "parts", "probe_parts", part.alias("part"), probe_part.alias("probe_part")), "alike-open"
    )
    shared = left.select("band", "key", "rep", "label", F.lit(False).alias("probe"), "parts", "part", F.explode(F.sequence(F.lit(0), F.col("probe_parts") - 1)).alias("i"))
    shared = shared.select("band", "key", (F.col("i") * F.col("parts") + F.col("part")).alias("cell"), "rep", "label", "probe")
    asked = left.where("probe").select("band", "key", "rep", "label", "probe", "parts", "probe_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    asked = asked.select("band", "key", (F.col("probe_part") * F.col("parts") + F.col("j")).alias("cell"), "rep", "label", "probe")
    if firsts is not None:
        firsts = firsts.join(left.groupBy("rep").agg(F.sort_array(F.collect_set(F.xxhash64("band", "key"))).alias("buckets")), "rep")
    more = _links(shared.unionByName(asked), contents_of, at_least, compared, firsts)
    final = connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return ids.join(final, ids["doc_id"] == final["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
