"""End-to-end flows of the service surface, composed from the operators, with recorded replies as inputs; and extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefall.functions import replies as P
from orefall.functions import text as X
from orefall.functions.scores import r6
from orefall.operators import chunking as C
from orefall.operators import evaluation as E
from orefall.operators import flows as Flow
from orefall.operators import repo as Repo
from orefall.operators import retrieval as R
from orefall.operators.state import latest
from orefall.plans.chunks import LINES, texts
from orefall.plans.evaluation import ONLINE, SECOND, final, tier_sql
from orefall.plans.registry import register
from orefall.plans.repo import BONUS, CLAIMS, TOKENS_CLAIM, claims
from orefall.plans.retrieval import CORPUS, Q, TOKENS, asked, bm25_sql
from orefall.plans.views import DOCS, ISS, TRACE, docs, events, issues, read


@register("pipe_analyze", f"WITH {LINES} SELECT split_part(file, '/', 1) AS source, count(*) AS n_chunks, CAST(sum(len({TOKENS.format('content')})) AS BIGINT) AS n_tokens FROM chunks GROUP BY 1")
def pipe_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, chunk and tokenise: chunks and tokens of each source."""
    chunks = C.chunk_files(texts(spark, sf_dir))
    return chunks.groupBy(F.split("file", "/")[0].alias("source")).agg(F.count("*").alias("n_chunks"), F.sum(F.size(X.tokenize(F.col("content")))).alias("n_tokens"))


# Rounds of an analysis: round r of a source selects its files of the r-th size class; what is labelled is known before.
ROUNDS = f"""{DOCS}, sized AS (SELECT source, doc_id, CASE WHEN length(text) >= 9000 THEN 5 WHEN length(text) >= 3000 THEN 4 WHEN length(text) >= 1200 THEN 3 WHEN length(text) >= 400 THEN 2 ELSE 1 END AS round FROM docs),
r AS (SELECT source AS key, round, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS n_new FROM sized GROUP BY source, round)"""


@register("pipe_rounds", f"WITH {ROUNDS}, s AS (SELECT *, min(CASE WHEN n_new = 0 THEN round END) OVER (PARTITION BY key) AS stop FROM r WHERE round <= 4) SELECT key, round, CASE WHEN round = stop THEN 'stopped' WHEN round = 4 THEN 'limit' ELSE 'continued' END AS status FROM s WHERE stop IS NULL OR round <= stop")
def pipe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four rounds of a source; one that selects nothing new ends them."""
    n = F.length("text")
    at = F.lit(1) + sum(((n >= size).cast("int") for size in (400, 1200, 3000, 9000)), F.lit(0))
    known = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    sized = docs(spark, sf_dir).select("source", "doc_id", at.alias("round")).join(known, "doc_id", "left")
    return Flow.rounds(sized.groupBy(F.col("source").alias("key"), "round").agg(F.count_if(F.col("known").isNull()).alias("n_new")))


@register("pipe_chat", f"WITH {CORPUS}, {Q}, {bm25_sql('b', 'q', 6)} SELECT qid, md5(string_agg('--- File: ' || file || ' ---' || chr(10) || left(text, 2000), chr(10) || chr(10) ORDER BY rank)) AS block, count(*) AS n FROM b JOIN docs USING (doc_id) GROUP BY qid")
def pipe_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve six and build the context block of each question."""
    d = docs(spark, sf_dir)
    hits = R.bm25_search(asked(spark, sf_dir), d, 6).join(d, "doc_id")
    line = F.concat(F.lit("--- File: "), "file", F.lit(" ---\n"), F.substring("text", 1, 2000))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.groupBy("qid").agg(F.md5(F.array_join(lines, "\n\n")).alias("block"), F.count("*").alias("n"))


# Claims of a paper are judged twice by recorded replies; its repository is the source of its number, whose labelled files are indexed at first.
SESSIONS = f"""{CLAIMS}, lettered AS (SELECT paper || ':' || row_number() OVER (PARTITION BY paper ORDER BY claim) AS qid, paper, 'src' || (paper % 20) AS session, claim AS text, status FROM claims),
files AS (SELECT source AS session, source || '/' || array_to_string(list_transform(string_split(left(text, 60), ' ')[1:3], lambda x: lower(x)), '_') || '_' || doc_id || '.py' AS path, doc_id AS pos, doc_id, text FROM documents),
known AS (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels))"""
JIT = f"""cand AS (SELECT l.qid, f.path, f.doc_id, f.pos, len(list_filter({TOKENS_CLAIM.format('l.text')}, lambda t: contains(lower(f.path), t))) + {BONUS.replace('lower(text)', 'lower(l.text)').replace('lower(path)', 'lower(f.path)')} AS score
  FROM lettered l JOIN files f USING (session) WHERE l.status IN ('missing', 'insufficient_evidence') AND f.doc_id NOT IN (SELECT doc_id FROM known)),
jit AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, length(path), pos) AS rank FROM cand WHERE score > 0) WHERE rank <= 3)"""
JIT_CORPUS = CORPUS.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT doc_id FROM {0}))")


def claim_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("paper").orderBy("claim"))
    c = claims(spark, sf_dir).withColumn("n", number)
    return c.select(F.concat_ws(":", "paper", "n").alias("qid"), "paper", F.concat(F.lit("src"), F.col("paper") % 20).alias("session"), F.col("claim").alias("text"), "status")


def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.array_join(F.transform(F.slice(F.split(F.substring("text", 1, 60), " "), 1, 3), F.lower), "_")
    return read(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.concat("source", F.lit("/"), name, F.lit("_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("doc_id").alias("pos"), "doc_id", "text")


def judgements(rows: DataFrame) -> DataFrame:
    """Recorded replies of both rounds: the first as recorded, the second by the claim's length."""
    n = F.length("text") % 3
    again = rows.select("qid", F.lit(1).alias("round"), F.when(n == 0, "aligned").when(n == 1, "partial").otherwise("missing").alias("status"))
    return rows.select("qid", F.lit(0).alias("round"), "status").unionByName(again)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, files = claim_sessions(spark, sf_dir), session_files(spark, sf_dir)
    known = files.join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("session", "path")
    return Flow.align(rows.drop("status"), files, known, judgements(rows))


ALIGN = f"""{SESSIONS}, {JIT}, {JIT_CORPUS.format('known')}, {bm25_sql('b', 'lettered', 5)},
al AS (SELECT l.qid, l.paper, CAST(coalesce(h.n, 0) AS INTEGER) AS hits, CAST(coalesce(j.n, 0) AS INTEGER) AS jit_files,
  CASE WHEN j.n > 0 THEN CASE length(l.text) % 3 WHEN 0 THEN 'aligned' WHEN 1 THEN 'partial' ELSE 'missing' END ELSE l.status END AS status
  FROM lettered l LEFT JOIN (SELECT qid, count(*) AS n FROM b GROUP BY qid) h USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM jit JOIN documents USING (doc_id) WHERE trim(text) <> '' GROUP BY qid) j USING (qid))"""


@register("pipe_align_claims", f"WITH {ALIGN} SELECT qid, hits, jit_files, status FROM al")
def pipe_align_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim: evidence found, files fetched just in time, and how it is judged at last."""
    return aligned(spark, sf_dir).select("qid", "hits", "jit_files", "status")


@register(
    "pipe_align_post",
    f"""WITH {SESSIONS}, {JIT}, later AS (SELECT doc_id FROM known UNION SELECT doc_id FROM jit JOIN documents USING (doc_id) WHERE trim(text) <> ''), {JIT_CORPUS.format('later')}, again AS (SELECT qid, text FROM lettered WHERE qid IN (SELECT qid FROM jit JOIN documents USING (doc_id) WHERE trim(text) <> '')),
    {bm25_sql('b', 'again', 5)} SELECT qid, CAST(count(*) AS INTEGER) AS post_hits FROM b GROUP BY qid""",
)
def pipe_align_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claims that fetched files find in the index with these."""
    return aligned(spark, sf_dir).where("post_hits IS NOT NULL").select("qid", "post_hits")


@register("pipe_align", f"WITH {ALIGN} SELECT paper, count(*) AS n_claims, round(sum(CASE status WHEN 'aligned' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) / count(*) + 1e-9, 4) AS confidence FROM al GROUP BY paper")
def pipe_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, evidence, judgement, files just in time, second judgement, and the confidence of each paper."""
    return Repo.align_confidence(aligned(spark, sf_dir))


@register(
    "pipe_event_lines",
    f"""WITH {TRACE}, e AS (SELECT session, event_id, step, k, min(CASE WHEN k IS NULL OR latency > 99 THEN event_id END) OVER (PARTITION BY session) AS ends FROM trace)
SELECT session, event_id, CASE WHEN event_id = ends THEN '{{"type":"error","message":"serialization failed"}}' ELSE '{{"type":"' || step || '","k":' || k || '}}' END AS line FROM e WHERE ends IS NULL OR event_id <= ends""",
)
def pipe_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's events as lines; the first that cannot be written becomes an error line and ends them."""
    e = events(spark, sf_dir)
    line = F.when(F.col("k").isNotNull() & ~(F.col("latency") > 99), F.to_json(F.struct(F.col("step").alias("type"), "k")))
    return Flow.event_lines(e, "session", "event_id", line)


# Cached replies are the last documents of a source and language; what is asked anew is made of a page of its issues.
REPLAY = f"""{DOCS}, {ISS}, asked AS (SELECT session, unnest(['en', 'de', 'zh']) AS language FROM (SELECT DISTINCT source AS session FROM docs)),
cache AS (SELECT source AS session, lang AS language, arg_max(text, doc_id) AS hit FROM docs GROUP BY source, lang),
paged AS (SELECT 'src' || (number % 20) AS session, number, updated, title, row_number() OVER (PARTITION BY number % 20 ORDER BY updated DESC, number DESC) AS n FROM iss WHERE {{where}}),
made AS (SELECT session, string_agg({{line}}, chr(10) ORDER BY {{order}}) AS payload FROM paged WHERE n <= {{most}} GROUP BY session),
t AS (SELECT a.session, a.language, hit IS NOT NULL AS cached, coalesce(hit, payload) AS text FROM asked a LEFT JOIN cache USING (session, language) LEFT JOIN made USING (session))
SELECT session, language, cached, i AS pos, md5(substr(text, CAST(i * 900 + 1 AS BIGINT), 900)) AS part FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 900) AS BIGINT))) AS i FROM t)"""


def _replayed(spark: SparkSession, sf_dir: str, made: DataFrame) -> DataFrame:
    d = docs(spark, sf_dir)
    wanted = d.select(F.col("source").alias("session")).distinct().withColumn("language", F.explode(F.array(*map(F.lit, ("en", "de", "zh")))))
    cache = latest(d.select(F.col("source").alias("session"), F.col("lang").alias("language"), F.col("text").alias("payload"), "doc_id"), ["session", "language"], "doc_id", "payload")
    parts = Flow.replayed(wanted, cache, made, ["session", "language"], ["session"])
    return parts.select("session", "language", "cached", F.col("pos").cast("long").alias("pos"), F.md5("part").alias("part"))


def _paged(spark: SparkSession, sf_dir: str, where: str, line: Column, most: int, oldest_first: bool) -> DataFrame:
    rows = issues(spark, sf_dir).where(where).withColumn("session", F.concat(F.lit("src"), F.col("number") % 20))
    return Flow.page(rows, ["session"], [F.desc("updated"), F.desc("number")], line, most, oldest_first)


@register("pipe_issue_summary", "WITH " + REPLAY.format(where="state = 'open' AND label = 'bug'", line="'- #' || number || ' ' || title", order="n", most=30))
def pipe_issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached summary of a session in parts of 900, else the prompt of its newest page of open bugs."""
    return _replayed(spark, sf_dir, _paged(spark, sf_dir, "state = 'open' AND label = 'bug'", F.format_string("- #%d %s", "number", "title"), 30, False))


@register("pipe_roadmap", "WITH " + REPLAY.format(where="true", line="left(updated, 10) || ' ' || title", order="n DESC", most=10))
def pipe_roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached roadmap of a session, else its ten newest changes, the oldest first."""
    return _replayed(spark, sf_dir, _paged(spark, sf_dir, "true", F.concat_ws(" ", F.substring("updated", 1, 10), "title"), 10, True))


@register(
    "pipe_auto_eval",
    f"""WITH {SECOND}, g AS (SELECT *, {ONLINE.replace("WHEN NOT", "WHEN false AND NOT")} AS reason, row_number() OVER (PARTITION BY query ORDER BY conv_id, turn) AS nth FROM final)
SELECT CASE WHEN reason IS NOT NULL THEN 'skipped:' || reason WHEN nth > 1 THEN 'duplicate' WHEN status = 'needs_review' THEN 'review' ELSE {tier_sql('final_score')} END AS outcome, count(*) AS n FROM g GROUP BY 1""",
)
def pipe_auto_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, dedupe, judge, combine with the second score, then route or review: outcomes with their counts."""
    rows = final(spark, sf_dir)
    reason = E.online_reason(F.col("query"), F.lit("def "), F.col("answer"), F.col("repo_url"))
    at = F.struct("conv_id", "turn").alias("at")
    first = rows.select("query", at).groupBy("query").agg(F.min("at").alias("first_at"))
    marked = rows.withColumn("reason", reason).withColumn("at", at).join(first, "query")
    from orefall.functions.scores import tier

    outcome = F.when(F.col("reason").isNotNull(), F.concat(F.lit("skipped:"), "reason")).when(F.col("at") != F.col("first_at"), "duplicate").when(F.col("status") == "needs_review", "review").otherwise(tier(F.col("final_score")))
    return marked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@register("ui_counts", f"WITH {CLAIMS} SELECT CASE WHEN status = 'insufficient_evidence' THEN 'missing' ELSE status END AS status, count(*) AS n FROM claims GROUP BY 1")
def ui_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).groupBy(P.ui_status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


# Extensions: relational categories that analytics over the same tables need.
@register("ext_rollup", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"))
    return r.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@register("ext_cube", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@register("ext_semi_anti", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1")
def ext_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    kept = c.join(o.where("o_orderstatus = 'F'").select("c_custkey"), "c_custkey", "left_semi").join(o.where("o_orderpriority = '1-URGENT'").select("c_custkey"), "c_custkey", "left_anti")
    return kept.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@register("ext_asof", "SELECT event_id, last_purchase FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type = 'error'")
def ext_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase before each error of a user: as-of join by a window within the user."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w)).where("event_type = 'error'").select("event_id", "last_purchase")


@register("ext_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def ext_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
