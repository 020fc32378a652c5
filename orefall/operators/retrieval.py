"""Lexical and vector retrieval, fusion of rankings, and retrieval measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefall.config import RETRIEVAL, ROUTES
from orefall.functions.scores import r6
from orefall.functions.text import tokenize
from orefall.session import spread
from orefall.sources.files import scratch

DIGITS = 6  # scores are ranked as rounded, so that order does not hang on the last bits of a sum


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl). Documents without a term have no row."""
    tokens = docs.select(F.col(doc).alias("doc_id"), tokenize(F.col(text)).alias("tokens"))
    terms = tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Rows written once among the shared folders, since several steps read them."""
    spark = rows.sparkSession
    path = scratch(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def corpus_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, length): documents with each term; the row of the null term counts all documents and their tokens.

    One pass over the texts; only a count for each term and input split is shuffled.
    """
    tokens = spread(docs.select("doc_id", text), "doc_id").select(F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>")).alias("t"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("t").cast("long").alias("n")))
    each = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(0).cast("long").alias("n")))
    return tokens.select(F.explode(F.concat(whole, each)).alias("x")).groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.n").alias("length"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl, mean_idf, n_terms) of ``corpus_terms``; documents without terms count, with length 0."""
    total = terms.where("term IS NULL").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n_docs"), F.max("length").alias("n_tokens"))
    known = terms.where("term IS NOT NULL").crossJoin(F.broadcast(total))
    return known.agg(F.max("n_docs").alias("n_docs"), F.try_divide(F.max("n_tokens").cast("double"), F.max("n_docs")).alias("avgdl"), F.avg(raw_idf()).alias("mean_idf"), F.count("*").alias("n_terms"))


def raw_idf() -> Column:
    return F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def rank_by(query: str, score: str, order: str, k: int | Column | None = None) -> Column:
    return F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), order))


CELLS = 20_000_000  # queries times distinct query terms up to which the queries are one matrix


def bm25_search(queries: DataFrame, docs: DataFrame, k: int, cells: int = CELLS) -> DataFrame:
    """(qid, doc_id, score, rank): Okapi BM25 with floored negative idf, positive scores only, the k best a query.

    ``queries`` has (qid, text), ``docs`` (doc_id, text) with whole-number ids, each once; a
    term that a query repeats counts again. Where queries times terms are ``cells`` at most,
    the queries go to the documents as a matrix: each split scores its documents where it
    reads them and gives its k best a query, so no posting is ever shuffled, however common
    its term. Beyond, query terms are joined with postings.
    """
    asked = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    size = asked.agg(F.countDistinct("qid").alias("q"), F.countDistinct("term").alias("t")).head()
    terms = stored(corpus_terms(docs), "terms")
    p, stats = RETRIEVAL, corpus_stats(terms)
    idf = terms.join(F.broadcast(asked.select("term").distinct()) if size["t"] <= cells else asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(stats))
    idf = idf.select("term", "avgdl", F.when(raw_idf() < 0, p.bm25_floor * F.col("mean_idf")).otherwise(raw_idf()).alias("idf"))
    if size["q"] * size["t"] > cells:
        weight = F.col("qtf") * F.col("idf") * F.col("tf") * (p.bm25_k1 + 1) / (F.col("tf") + p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * F.col("dl") / F.col("avgdl")))
        scored = asked.join(idf, "term").join(postings(docs), "term").groupBy("qid", "doc_id").agg(r6(F.sum(weight)).alias("score"))
        best = scored.where("score > 0")
    else:
        best = _scored_in_place(asked.join(idf, "term"), docs, k)
    return best.withColumn("rank", rank_by("qid", "score", "doc_id")).where(F.col("rank") <= k)


def _scored_in_place(asked: DataFrame, docs: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(qid, doc_id, score): the k best of each split for each query, from (qid, term, qtf, idf, avgdl) of a bounded size."""
    got = asked.orderBy("term", "qid").toArrow()
    kind = dict(asked.dtypes)["qid"]
    words, at = np.unique(np.array(got.column("term").to_pylist(), dtype=object), return_inverse=True)
    qids, row = np.unique(got.column("qid").to_numpy(), return_inverse=True)
    asks = np.zeros((len(words), len(qids)))
    asks[at, row] = got.column("qtf").to_numpy()
    idf = np.zeros(len(words))
    idf[at] = got.column("idf").to_numpy()
    avgdl = got.column("avgdl")[0].as_py() if got.num_rows else None
    shared = docs.sparkSession.sparkContext.broadcast((words.tolist(), qids, asks, idf))
    p = RETRIEVAL

    def weights(tokens: pa.ListArray, known: pa.Array, idf: np.ndarray) -> np.ndarray:
        """(documents, terms): what a term adds to a document for each time that a query has it."""
        lengths = pc.list_value_length(tokens).to_numpy()
        codes = pc.index_in(tokens.flatten(), known)
        doc, hit = np.repeat(np.arange(len(lengths)), lengths), pc.is_valid(codes).to_numpy(zero_copy_only=False)
        spots, tf = np.unique(doc[hit] * len(known) + codes.drop_null().to_numpy(), return_counts=True)
        d, t = np.divmod(spots, len(known))
        out = np.zeros((len(lengths), len(known)))
        out[d, t] = idf[t] * tf * (p.bm25_k1 + 1) / (tf + p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * lengths[d] / avgdl))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, qids, asks, idf = shared.value
        if not len(words) or not avgdl:
            return
        known = pa.array(words, pa.string())
        scores, ids = np.zeros((len(qids), k)), np.full((len(qids), k), np.iinfo(np.int64).max)
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                new = np.round(weights(part.column("t"), known, idf) @ asks + 1e-9, DIGITS).T
                numbers = np.broadcast_to(part.column("doc_id").to_numpy(), new.shape)
                scores, ids = np.concatenate([scores, new], axis=1), np.concatenate([ids, numbers], axis=1)
                order = np.lexsort((ids, -scores), axis=1)[:, :k]
                scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        q, j = np.nonzero(scores > 0)
        yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[q, j]), pa.array(scores[q, j])], names=["qid", "doc_id", "score"])

    tokens = spread(docs.select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("long"), F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("t"))
    return tokens.mapInArrow(run, f"qid {kind}, doc_id long, score double")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(qid, doc_id, score, rank): the k vectors with the highest cosine, floor 0, for each query vector.

    Exact: both sides are cut to blocks of about ``block`` rows, each pair of blocks is one
    matrix product, and only k rows a query leave it. Vectors that are null or hold a null
    find nothing and are not found; vectors of different lengths are not compared.
    """
    n_q, n_d = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // block))
    usable = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    q = queries.select("qid", F.col("embedding").cast("array<double>").alias("v")).where(usable)
    q = q.select("*", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("db"))
    d = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("v")).where(usable)
    d = d.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(n_d)).cast("int").alias("db"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    floor = RETRIEVAL.vector_floor

    def of_one_length(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = np.array(left["v"].tolist()), np.array(right["v"].tolist())
        with np.errstate(invalid="ignore", divide="ignore"):
            s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        s = np.round(np.nan_to_num(s, nan=-1.0) + 1e-9, DIGITS)
        ids = right["doc_id"].to_numpy()
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        out = pd.DataFrame({"qid": np.repeat(left["qid"].to_numpy(), order.shape[1]), "doc_id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
        return out[out["score"] >= floor]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        sizes = left["v"].map(len), right["v"].map(len)
        return pd.concat([none, *(of_one_length(left[sizes[0] == n], right[sizes[1] == n]) for n in set(sizes[0]) & set(sizes[1]))], ignore_index=True)

    near = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(best, "qid long, doc_id long, score double")
    return near.withColumn("rank", rank_by("qid", "score", "doc_id")).where(F.col("rank") <= k)


def rrf(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank): reciprocal rank fusion of two rankings; ties go to the vector list, then the lexical one."""
    p = RETRIEVAL
    v = vector.select("qid", "doc_id", F.col("rank").alias("rv"))
    b = lexical.select("qid", "doc_id", F.col("rank").alias("rb"))
    both = v.join(b, ["qid", "doc_id"], "full_outer")
    score = F.coalesce(p.weight_vector / (p.rrf_k + F.col("rv")), F.lit(0.0)) + F.coalesce(p.weight_bm25 / (p.rrf_k + F.col("rb")), F.lit(0.0))
    fused = both.select("qid", "doc_id", F.round(score, 9).alias("score"), F.coalesce("rv", F.col("rb") + 1_000_000).alias("first_seen"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first_seen", "doc_id")))
    return ranked.where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")


def hybrid_search(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, k: int = RETRIEVAL.top_k) -> DataFrame:
    """Vector and BM25 candidates (twice k each) fused by reciprocal rank."""
    wide = k * RETRIEVAL.oversample
    return rrf(vector_search(query_vectors, doc_vectors, wide), bm25_search(queries, docs, wide), k)


def multi_route(hits: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) from (qid, route, weight, doc_id, rank): weight / rank, summed; ties by route and rank."""
    summed = hits.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("weight") / F.col("rank")), 9).alias("score"), F.min(F.col("route") * 1000 + F.col("rank")).alias("first_seen"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first_seen", "doc_id")))
    return ranked.where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")


def route_limit(k: int) -> int:
    return max(3, min(12, k))


def with_fallback(first: DataFrame, expanded: DataFrame, k: int) -> DataFrame:
    """Hits of the first round and, for queries with under max(2, k div 2) distinct documents, the expanded ones at 0.9 of their weight."""
    thin = first.select("qid", "doc_id").distinct().groupBy("qid").count().where(F.col("count") >= max(2, k // 2)).select("qid")
    more = expanded.join(thin, "qid", "left_anti").withColumn("weight", F.col("weight") * ROUTES.expanded).withColumn("route", F.col("route") + 10)
    return first.unionByName(more)


def retrieval_rows(ranked: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Per query: hit, recall, precision (of distinct retrieved), mrr, integrity, from (qid, file, rank) and (qid, file)."""
    got = ranked.where(F.col("rank") <= k).groupBy("qid", "file").agg(F.min("rank").alias("rank"))
    marked = got.join(truth.select("qid", "file", F.lit(1).alias("t")).distinct(), ["qid", "file"], "left")
    per = marked.groupBy("qid").agg(F.count("*").alias("n_retrieved"), F.count("t").alias("n_hits"), F.min(F.when(F.col("t") == 1, F.col("rank"))).alias("first_hit"))
    wanted = truth.select("qid", "file").distinct().groupBy("qid").agg(F.count("*").alias("n_expected"))
    rows = queries.select("qid").join(wanted, "qid", "left").join(per, "qid", "left").fillna(0, ["n_expected", "n_retrieved", "n_hits"])
    ratio = lambda a, b: r6(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)))
    return rows.select(
        "qid", "n_expected", "n_retrieved", (F.col("n_hits") > 0).cast("int").alias("hit"), ratio("n_hits", "n_expected").alias("recall"),
        ratio("n_hits", "n_retrieved").alias("precision"), r6(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))).alias("mrr"),
        r6(F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(1.0), F.col("n_retrieved"))), F.lit(0.0))).alias("integrity"),
    )
