"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length 1 and halved. Each half has its own codebook (k-means in numpy on
a bounded sample), and the product of both is a grid of cells. A query walks the cells by the
sum of its distances to the two centroids (multi-sequence algorithm), as many as reach the
target recall on the sample; the vectors in these cells are verified by cosine in double
precision.

Equal vectors are folded to one representative with a count. Cells are joined in tiles (a
chunk of the cell's members against a chunk of the queries that visit it), so a hot cell is
split over tasks; a tile puts out counts of links and a spanning forest, never pairs. A pair is
counted once for each side whichever side found it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import maybe_broadcast, shuffle_partitions, store
from orefall.llm.components import connected_components
from orefall.llm.simhash import _forest

SAMPLE = 8_000  # bound on the vectors that codebooks and the walk's length are fitted on
TILE = 1024
MIN_COSINE = 0.9


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None]


def multi_sequence(a: np.ndarray, b: np.ndarray, steps: int) -> list[tuple[int, int]]:
    """The ``steps`` cells (i, j) with the smallest a[i] + b[j], in order."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[ia], b[ib]
    heap, out = [(sa[0] + sb[0], 0, 0)], []
    reached = [0] * len(sa)  # how far row r has been walked
    while heap and len(out) < steps:
        _, r, c = heapq.heappop(heap)
        out.append((int(ia[r]), int(ib[c])))
        reached[r] = c + 1
        if c + 1 < len(sb) and (r == 0 or reached[r - 1] > c + 1):
            heapq.heappush(heap, (sa[r] + sb[c + 1], r, c + 1))
        if r + 1 < len(sa) and reached[r + 1] == c:
            heapq.heappush(heap, (sa[r + 1] + sb[c], r + 1, c))
    return out


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    steps: int

    @property
    def width(self) -> int:
        return len(self.second)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _distances(unit[:, :half], self.first), _distances(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        da, db = self.distances(unit)
        return da.argmin(axis=1) * self.width + db.argmin(axis=1)

    def walks(self, unit: np.ndarray, steps: int | None = None) -> list[list[int]]:
        da, db = self.distances(unit)
        return [[i * self.width + j for i, j in multi_sequence(a, b, steps or self.steps)] for a, b in zip(da, db, strict=True)]


def fit(unit: np.ndarray, n_vectors: int, target: float = 0.98, least: float = MIN_COSINE, seed: int = 9) -> MultiIndex:
    """Codebooks for about 50 vectors a cell, and the number of cells to walk.

    The walk is long enough that ``target`` of test neighbours lie in its cells: the sample's
    own links, and neighbours made at random cosines between ``least`` and 1, which stand in
    where the sample has few links.
    """
    k = int(np.clip(round((max(1, n_vectors) / 50) ** 0.5), 2, 512))
    half = unit.shape[1] // 2
    index = MultiIndex(kmeans(unit[:, :half], k), kmeans(unit[:, half:], k), 1)
    rng = np.random.default_rng(seed)
    queries = unit[rng.permutation(len(unit))[:400]]
    cells = index.cells(unit)
    limit = min(k * k, 2048)
    walks = index.walks(queries, limit)
    depths = []
    for q, walk in zip(queries, walks, strict=True):
        order = {c: r for r, c in enumerate(walk)}
        links = np.flatnonzero(unit @ q >= least)
        depths += [order.get(c, limit) for c in cells[links]]
    cos = rng.uniform(least, 1, len(queries))
    noise = rng.normal(size=queries.shape)
    noise -= (noise * queries).sum(axis=1, keepdims=True) * queries
    noise /= np.linalg.norm(noise, axis=1, keepdims=True) + 1e-12
    made = cos[:, None] * queries + np.sqrt(1 - cos**2)[:, None] * noise
    made_depths = [walk.index(c) if c in walk else limit for walk, c in zip(walks, index.cells(made), strict=True)]
    steps = max(np.quantile(depths, target) if depths else 0, np.quantile(made_depths, 0.93)) + 1
    index.steps = int(min(limit, max(4, np.ceil(steps))))
    return index


def _width(vectors: DataFrame) -> type:
    """Packed vectors keep the table's own precision: what is moved for a float column is half of what doubles take."""
    return np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, key): the packed vector of each row whose embedding has ``dim`` finite components, not all zero."""
    width = _width(vectors)
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(width).reshape(-1, dim) + width(0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["vec_id", "key"])

    return vectors.where(_usable_column(dim)).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(pack, "vec_id long, key binary")


def _units(packed: list[bytes], dim: int, width: type) -> np.ndarray:
    """Unit vectors in double precision; very small and very large ones are scaled before they are squared."""
    x = np.frombuffer(b"".join(packed), dtype=width).reshape(-1, dim).astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        squares = (x**2).sum(axis=1)
    odd = ~((squares > 1e-200) & (squares < 1e200))
    if odd.any():
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        squares[odd] = (x[odd] ** 2).sum(axis=1)
    return x / np.sqrt(squares)[:, None]


def _tiles(dim: int, least: float, width: type):
    """Members and queries of one tile after another: counts of links and spanning stars."""

    def solve(cols: dict[str, list]) -> pa.RecordBatch:
        member = np.array(cols["side"]) == 0
        unit = _units(cols["key"], dim, width)
        rep, count, home = (np.array(cols[c], np.int64) for c in ("rep", "copies", "home"))
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        out = {k: [] for k in ("a", "b", "n")}
        left, right = [], []
        visits = [np.frombuffer(cols["walk"][i], dtype=np.int64) for i in m]
        # mutual[r, h]: member r's walk comes by the query's own cell, so the pair is also found there.
        homes, where = np.unique(home[q], return_inverse=True)
        mutual = np.array([np.isin(homes, v) for v in visits]).reshape(len(m), len(homes))
        got = np.zeros(len(rep), np.int64)
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            near = (unit[m] @ unit[part].T >= least) & (rep[m][:, None] != rep[part][None])
            got[part] += (near * count[m][:, None]).sum(axis=0)
            got[m] += ((near & ~mutual[:, where[lo : lo + 512]]) * count[part][None]).sum(axis=1)
            a, b = np.nonzero(near)
            left.append(m[a])
            right.append(part[b])
        nodes, roots = _spanning(rep, np.concatenate(left) if left else m[:0], np.concatenate(right) if right else m[:0])
        hit = np.flatnonzero(got)
        out["a"] = np.r_[rep[hit], nodes]
        out["b"] = np.r_[np.full(len(hit), -(2**63)), roots]
        out["n"] = np.r_[got[hit], np.zeros(len(nodes), np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(out[k]) for k in ("a", "b", "n")], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "mine", "theirs", "side", "rep", "copies", "home", "key", "walk"]
        held: dict[str, list] = {k: [] for k in names}
        for b in batches:
            cols = {k: b.column(k).to_pylist() for k in names}
            tile = list(zip(cols["cell"], cols["mine"], cols["theirs"], strict=True))
            at = 0
            while at < len(tile):
                if held["cell"] and tile[at] != (held["cell"][0], held["mine"][0], held["theirs"][0]):
                    if 0 < sum(held["side"]) < len(held["side"]):
                        yield solve(held)
                    held = {k: [] for k in names}
                stop = at
                while stop < len(tile) and tile[stop] == tile[at]:
                    stop += 1
                for k in names:
                    held[k] += cols[k][at:stop]
                at = stop
        if held["cell"] and 0 < sum(held["side"]) < len(held["side"]):
            yield solve(held)

    return run


def _spanning(rep: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As the SimHash forest, for rows of which several may stand for one node."""
    nodes, spot = np.unique(rep, return_inverse=True)
    return _forest(nodes, nodes, spot[left], spot[right])


def near_vectors(vectors: DataFrame, least: float = MIN_COSINE, index: MultiIndex | None = None, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Null, zero and non-finite vectors, and those whose length is not the table's most common
    one, link with nothing. Rows that repeat a vec_id count as vectors of their own. A null
    vec_id links with nothing and has a null component.
    """
    spark = vectors.sparkSession
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if sizes is None or not sizes["d"]:
        return vectors.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim, width = sizes["d"], _width(vectors)
    packed = store(usable(vectors, dim), "vectors")
    reps = store(packed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")
    if index is None:
        n = reps.count()
        sample = reps.select("key").orderBy(F.xxhash64("key")).limit(SAMPLE).toArrow().column("key").combine_chunks()
        unit = _units(sample.to_pylist(), dim, width) if len(sample) else np.eye(max(2, dim))[:2]
        index = fit(unit, n, least=least)
    shared = spark.sparkContext.broadcast(index)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit = _units(b.column("key").to_pylist(), dim, width)
            walks = [np.array(sorted(w), np.int64) for w in shared.value.walks(unit)]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("rep"), b.column("copies"), pa.array(shared.value.cells(unit).astype(np.int64)), pa.array([w.tobytes() for w in walks], pa.binary()), pa.array([w.tolist() for w in walks], pa.list_(pa.int64()))],
                names=["key", "rep", "copies", "home", "walk", "cells"],
            )

    placed = store(reps.mapInArrow(walk, "key binary, rep long, copies long, home long, walk binary, cells array<long>"), "walks")
    members = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("nm"))
    visitors = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("nq"))
    # Only cells with members; one row a cell of the grid.
    plan = store(members.join(visitors, "cell").select("cell", F.ceil(F.col("nm") / tile).cast("int").alias("pm"), F.ceil(F.col("nq") / tile).cast("int").alias("pq")), "cells")
    plan = maybe_broadcast(plan, 300_000)
    spread = lambda side, parts: F.pmod(F.xxhash64("rep", F.lit(side)), F.col(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    inside = placed.withColumn("cell", F.col("home")).join(plan, "cell").select("cell", spread("m", "pm").alias("mine"), all_of("pq").alias("theirs"), F.lit(0).alias("side"), "rep", "copies", "home", "key", "walk")
    asking = placed.select("rep", "copies", "home", "key", F.explode("cells").alias("cell")).join(plan, "cell").select("cell", spread("q", "pq").alias("theirs"), all_of("pm").alias("mine"), F.lit(1).alias("side"), "rep", "copies", "home", "key", F.lit(b"").alias("walk"))
    tiles = inside.unionByName(asking).repartition(shuffle_partitions(spark), "cell", "mine", "theirs").sortWithinPartitions("cell", "mine", "theirs")
    found = store(tiles.mapInArrow(_tiles(dim, least, width), "a long, b long, n long"), "links-found")
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("n = 0").select("a", "b"))
    classes = reps.join(links, "rep", "left").join(comps, F.col("rep") == comps["node"], "left")
    classes = classes.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = packed.join(classes, "key").select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long"), "embedding").where(~_usable_column(dim)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _usable_column(dim: int):
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & F.col("vec_id").isNotNull()
    ok = ok & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return F.coalesce(ok, F.lit(False))
