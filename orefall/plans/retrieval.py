"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.config import RETRIEVAL, ROUTES
from orefall.functions.text import tokenize
from orefall.operators import retrieval as R
from orefall.plans.registry import register
from orefall.plans.views import DOCS, docs, read
from orefall.session import spread
from orefall.functions.scores import r6

_P = RETRIEVAL
TOKENS = "list_transform(list_filter(regexp_split_to_array({0}, '[^a-zA-Z0-9_.@一-龥]+'), lambda t: t <> ''), lambda t: lower(t))"
CORPUS = f"""{DOCS},
toks AS (SELECT doc_id, {TOKENS.format("text")} AS tokens FROM docs),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks) GROUP BY doc_id, term),
size AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM toks),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, n_docs, avgdl, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM dfs CROSS JOIN size),
mean AS (SELECT avg(idf) AS mean_idf, count(*) AS n_terms FROM raw)"""


def bm25_sql(name: str, queries: str, k: int) -> str:
    """CTE ``name`` (qid, doc_id, score, rank) over the CTE ``queries`` (qid, text)."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT qid, doc_id, round(sum(qtf * i.idf * tf * {_P.bm25_k1 + 1} / (tf + {_P.bm25_k1} * (1 - {_P.bm25_b} + {_P.bm25_b} * dl / avgdl))), 6) AS score
      FROM (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({TOKENS.format("text")}) AS term FROM {queries}) GROUP BY qid, term)
      JOIN (SELECT term, avgdl, CASE WHEN idf < 0 THEN {_P.bm25_floor} * mean_idf ELSE idf END AS idf FROM raw CROSS JOIN mean) i USING (term)
      JOIN post USING (term) GROUP BY qid, doc_id) WHERE score > 0) WHERE rank <= {k})"""


def vector_sql(name: str, queries: str, vectors: str, k: int) -> str:
    """CTE ``name`` (qid, doc_id, score, rank) over (qid, embedding) and (doc_id, embedding)."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT qid, doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM {queries} q CROSS JOIN {vectors} d)
    WHERE score >= 0) WHERE rank <= {k})"""


Q = "q AS (SELECT item_id AS qid, text FROM benchmark)"
VQ = "vq AS (SELECT vec_id AS qid, embedding, label FROM embeddings WHERE vec_id % 20 = 0)"
VD = "vd AS (SELECT vec_id AS doc_id, embedding, label FROM embeddings)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every id divisible by 20."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", "label")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


@register("tokenize_docs", f"WITH {DOCS} SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS tokens FROM docs)")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("bm25_stats", f"WITH {CORPUS} SELECT n_docs, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf, n_terms FROM size CROSS JOIN mean")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.corpus_stats(R.stored(R.corpus_terms(docs(spark, sf_dir)), "terms"))
    return s.select("n_docs", r6("avgdl").alias("avgdl"), r6("mean_idf").alias("mean_idf"), "n_terms")


@register("bm25_topk", f"WITH {CORPUS}, {Q}, {bm25_sql('b', 'q', 6)} SELECT qid, doc_id, score, rank FROM b")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_search(asked(spark, sf_dir), docs(spark, sf_dir), 6).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@register("vector_topk", f"WITH {VQ}, {VD}, {vector_sql('v', 'vq', 'vd', 6)} SELECT qid, doc_id, score, rank FROM v")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_search(query_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), 6).withColumn("rank", F.col("rank").cast("long"))


@register("vector_topk_filtered", f"WITH {VQ}, vf AS (SELECT vec_id AS doc_id, embedding FROM embeddings WHERE label = 3), {vector_sql('v', 'vq', 'vf', 6)} SELECT qid, doc_id, score, rank FROM v")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_search(query_vectors(spark, sf_dir), doc_vectors(spark, sf_dir).where("label = 3"), 6).withColumn("rank", F.col("rank").cast("long"))


# Hybrid: item i asks with its text and with vector i; a document has the vector of its id, where there is one.
HYBRID = f"""{CORPUS}, {Q}, hq AS (SELECT item_id AS qid, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
hd AS (SELECT doc_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id)"""
RRF = f"""fused AS (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_seen, doc_id) AS rank FROM (
    SELECT coalesce(v.qid, b.qid) AS qid, coalesce(v.doc_id, b.doc_id) AS doc_id, coalesce(v.rank, b.rank + 1000000) AS first_seen,
           round(coalesce({_P.weight_vector} / ({_P.rrf_k} + v.rank), 0) + coalesce({_P.weight_bm25} / ({_P.rrf_k} + b.rank), 0), 9) AS score
    FROM v FULL OUTER JOIN b ON v.qid = b.qid AND v.doc_id = b.doc_id))"""


def hybrid_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    hq = asked(spark, sf_dir).join(e, F.col("qid") == e["vec_id"]).select("qid", "embedding")
    hd = read(spark, sf_dir, "documents").select("doc_id").join(e, F.col("doc_id") == e["vec_id"]).select("doc_id", "embedding")
    return hq, hd


@register("rrf_fusion", f"WITH {HYBRID}, {vector_sql('v', 'hq', 'hd', 12)}, {bm25_sql('b', 'q', 12)}, {RRF} SELECT qid, doc_id, score, rank FROM fused WHERE rank <= 12")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hq, hd = hybrid_parts(spark, sf_dir)
    fused = R.rrf(R.vector_search(hq, hd, 12), R.bm25_search(asked(spark, sf_dir), docs(spark, sf_dir), 12), 12)
    return fused.withColumn("rank", F.col("rank").cast("long"))


@register("hybrid_search", f"WITH {HYBRID}, {vector_sql('v', 'hq', 'hd', 6)}, {bm25_sql('b', 'q', 6)}, {RRF} SELECT qid, doc_id, score, rank FROM fused WHERE rank <= 3")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hq, hd = hybrid_parts(spark, sf_dir)
    return R.hybrid_search(asked(spark, sf_dir), docs(spark, sf_dir), hq, hd).withColumn("rank", F.col("rank").cast("long"))


# Four routes a claim: the whole text, its long tokens, its even and its odd tokens.
TOP = 6


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = asked(spark, sf_dir).select("qid", "text", tokenize(F.col("text")).alias("t"))
    at = lambda rest: F.array_join(F.filter("t", lambda x, i: i % 2 == rest), " ")
    forms = F.array(F.col("text"), F.array_join(F.filter("t", lambda x: F.length(x) > 6), " "), at(0), at(1))
    weights = F.array(*map(F.lit, ROUTES.weights))
    return t.select("qid", F.posexplode(F.arrays_zip(forms.alias("text"), weights.alias("weight"))).alias("route", "r")).select("qid", "route", "r.text", "r.weight")


ROUTED = f"""{CORPUS}, {Q},
routes AS (
  SELECT qid, route, text, weight FROM (
    SELECT qid, 0 AS route, text, {ROUTES.weights[0]} AS weight FROM q
    UNION ALL SELECT qid, 1, array_to_string(list_filter({TOKENS.format("text")}, lambda t: length(t) > 6), ' '), {ROUTES.weights[1]} FROM q
    UNION ALL SELECT qid, 2, array_to_string(list_filter({TOKENS.format("text")}, lambda t, i: i % 2 = 1), ' '), {ROUTES.weights[2]} FROM q
    UNION ALL SELECT qid, 3, array_to_string(list_filter({TOKENS.format("text")}, lambda t, i: i % 2 = 0), ' '), {ROUTES.weights[3]} FROM q)),
rq AS (SELECT qid * 4 + route AS qid, text FROM routes)"""


def routed(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    r = routes(spark, sf_dir)
    hits = R.bm25_search(r.select((F.col("qid") * 4 + F.col("route")).alias("qid"), "text"), docs(spark, sf_dir), k)
    back = hits.select(F.floor(F.col("qid") / 4).cast("long").alias("qid"), (F.col("qid") % 4).cast("int").alias("route"), "doc_id", "rank")
    return back.join(r.select("qid", "route", "weight"), ["qid", "route"])


def routed_sql(name: str, k: int) -> str:
    return bm25_sql(f"{name}_b", "rq", k) + f", {name} AS (SELECT r.qid, r.route, r.weight, h.doc_id, h.rank FROM {name}_b h JOIN routes r ON h.qid = r.qid * 4 + r.route)"


def fuse_sql(source: str, k: int) -> str:
    return f"""SELECT qid, doc_id, score, rank FROM (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_seen, doc_id) AS rank FROM (
    SELECT qid, doc_id, round(sum(weight / rank), 9) AS score, min(route * 1000 + rank) AS first_seen FROM {source} GROUP BY qid, doc_id)) WHERE rank <= {k}"""


@register("multi_route_fusion", f"WITH {ROUTED}, {routed_sql('m', 6)} {fuse_sql('m', TOP)}")
def multi_route_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.multi_route(routed(spark, sf_dir, R.route_limit(TOP)), TOP).withColumn("rank", F.col("rank").cast("long"))


WIDE = 14


@register(
    "route_fallback",
    f"""WITH {ROUTED}, {routed_sql('m', 6)}, {routed_sql('x', 20)},
wide AS (SELECT qid FROM m GROUP BY qid HAVING count(DISTINCT doc_id) >= {WIDE // 2}),
u AS (SELECT qid, route, weight, doc_id, rank FROM m UNION ALL SELECT qid, route + 10, weight * {ROUTES.expanded}, doc_id, rank FROM x WHERE route < 2 AND qid NOT IN (SELECT qid FROM wide))
{fuse_sql('u', WIDE)}""",
)
def route_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large k with narrow routes, so that the second round is needed for some claims."""
    first, more = routed(spark, sf_dir, 6), routed(spark, sf_dir, min(20, 2 * WIDE + 4)).where("route < 2")
    return R.multi_route(R.with_fallback(first, more, WIDE), WIDE).withColumn("rank", F.col("rank").cast("long"))


@register("lateral_topk_per_query", f"WITH {CORPUS}, {Q}, {bm25_sql('b', 'q', 2)} SELECT qid, doc_id, rank FROM b")
def lateral_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlated top-k of each claim, as one join and one ranked window for all claims."""
    return R.bm25_search(asked(spark, sf_dir), docs(spark, sf_dir), 2).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


# Truth: documents that share a sentence of 30 characters or more with the item.
SENTENCES = "list_filter(string_split({0}, '.'), lambda s: length(trim(s)) >= 30)"
TRUTH = f"""truth AS (SELECT DISTINCT qid, file FROM (SELECT item_id AS qid, trim(unnest({SENTENCES.format("text")})) AS s FROM benchmark)
  JOIN (SELECT file, trim(unnest({SENTENCES.format("text")})) AS s FROM docs) USING (s))"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda c: F.explode(F.filter(F.transform(F.split(c, "\\."), lambda s: F.trim(s)), lambda s: F.length(s) >= 30)).alias("s")
    items = asked(spark, sf_dir).select("qid", cut("text"))
    return items.join(docs(spark, sf_dir).select("file", cut("text")), "s").select("qid", "file").distinct()


RANKED = f"""{CORPUS}, {Q}, {bm25_sql('b', 'q', 5)}, {TRUTH},
got AS (SELECT qid, file, min(rank) AS rank FROM b JOIN docs USING (doc_id) GROUP BY qid, file),
per AS (SELECT g.qid, count(*) AS n_retrieved, count(t.file) AS n_hits, min(CASE WHEN t.file IS NOT NULL THEN rank END) AS first_hit FROM got g LEFT JOIN truth t ON g.qid = t.qid AND g.file = t.file GROUP BY g.qid),
rows_ AS (
  SELECT q.qid, coalesce(n_expected, 0) AS n_expected, coalesce(n_retrieved, 0) AS n_retrieved, CAST(coalesce(n_hits, 0) > 0 AS INTEGER) AS hit,
         round(CASE WHEN coalesce(n_expected, 0) = 0 THEN 0 ELSE coalesce(n_hits, 0) / n_expected END, 6) AS recall,
         round(CASE WHEN coalesce(n_retrieved, 0) = 0 THEN 0 ELSE n_hits / n_retrieved END, 6) AS precision,
         round(coalesce(1 / first_hit, 0), 6) AS mrr, round(CASE WHEN coalesce(n_retrieved, 0) = 0 THEN 0 ELSE least(1.0, 1 / n_retrieved) END, 6) AS integrity
  FROM q LEFT JOIN (SELECT qid, count(*) AS n_expected FROM truth GROUP BY qid) w USING (qid) LEFT JOIN per USING (qid))"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = docs(spark, sf_dir), asked(spark, sf_dir)
    ranked = R.bm25_search(q, d, 5).join(d.select("doc_id", "file"), "doc_id").select("qid", "file", "rank")
    return R.retrieval_rows(ranked, truth(spark, sf_dir), q)


@register("retrieval_metrics", f"WITH {RANKED} SELECT qid, n_expected, n_retrieved, hit, recall, precision, mrr, integrity, round(0.3 * recall + 0.3 * precision + 0.25 * precision + 0.15 * integrity, 6) AS overall FROM rows_")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = 0.3 * F.col("recall") + 0.3 * F.col("precision") + 0.25 * F.col("precision") + 0.15 * F.col("integrity")
    return measured(spark, sf_dir).withColumn("overall", r6(overall))


_MACRO = "count(*) AS n_total, count(*) FILTER (n_expected > 0) AS n_evaluated, round(sum(hit) / count(*), 6) AS hit_rate, round(avg(recall) FILTER (n_expected > 0), 6) AS recall, round(avg(precision) FILTER (n_expected > 0), 6) AS precision, round(avg(mrr) FILTER (n_expected > 0), 6) AS mrr"


def _macro() -> list:
    mean = lambda c: r6(F.avg(F.when(F.col("n_expected") > 0, F.col(c)))).alias(c)
    return [F.count("*").alias("n_total"), F.count_if(F.col("n_expected") > 0).alias("n_evaluated"), r6(F.sum("hit") / F.count("*")).alias("hit_rate"), mean("recall"), mean("precision"), mean("mrr")]


@register("retrieval_macro", f"WITH {RANKED} SELECT {_MACRO} FROM rows_")
def retrieval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits over all rows; recall, precision and MRR over rows with expected files."""
    return measured(spark, sf_dir).agg(*_macro())


_GROUP = "CASE WHEN qid % 3 = 0 THEN 'easy' WHEN qid % 3 = 1 THEN 'hard' ELSE 'medium' END"


@register("retrieval_by_group", f"WITH {RANKED} SELECT {_GROUP} AS difficulty, {_MACRO} FROM rows_ GROUP BY 1")
def retrieval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("qid") % 3 == 0, "easy").when(F.col("qid") % 3 == 1, "hard")
    return measured(spark, sf_dir).groupBy(F.coalesce(group, F.lit("medium")).alias("difficulty")).agg(*_macro())


@register("collection_stats", f"WITH {DOCS} SELECT source AS collection, count(*) AS n_points, count(DISTINCT file) AS n_files, CAST(max(length(text)) AS BIGINT) AS longest FROM docs GROUP BY source")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("n_points"), F.count_distinct("file").alias("n_files"), F.max(F.length("text")).cast("long").alias("longest"))


@register("docs_by_file", f"WITH {DOCS} SELECT source, doc_id, file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS start_line, 1.0 AS score FROM docs")
def docs_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of each file, in order, with the fixed score of a lookup."""
    from pyspark.sql import Window

    return docs(spark, sf_dir).select("source", "doc_id", "file", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("start_line"), F.lit(1.0).alias("score"))
