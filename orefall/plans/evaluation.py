"""Queries of the evaluation operators, over question-answer pairs and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefall import config
from orefall.functions import scores as S
from orefall.functions import text as X
from orefall.operators import evaluation as E
from orefall.plans.registry import register
from orefall.plans.views import QA, TRACE, events, literals, qa, read, sql_text, sql_values
from orefall.functions.scores import r6


def _list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def chatty_sql(q: str, least: int = 5) -> str:
    t = f"lower(trim({q}))"
    return f"({q} IS NULL OR {q} = '' OR length({t}) < {least} OR len(list_filter({_list(config.CHATTY)}, lambda p: {t} = p OR starts_with({t}, p || ' '))) > 0)"


def code_sql(t: str) -> str:
    return f"coalesce(len(list_filter({_list(config.CODE_MARKS)}, lambda m: contains({t}, m))) > 0, false)"


def words_sql(t: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''))"


def tier_sql(s: str) -> str:
    return f"CASE WHEN {s} >= 0.9 THEN 'gold' WHEN {s} >= 0.7 THEN 'silver' WHEN {s} >= 0.5 THEN 'bronze' ELSE 'rejected' END"


SCORED = f"""{QA},
w AS (SELECT *, {words_sql('query')} AS qw, {words_sql('answer')} AS aw, lower(context) AS lc FROM qa),
content AS (SELECT *, list_filter(aw, lambda x: NOT list_contains({_list(config.JUDGE_STOP)}, x)) AS cw FROM w),
judged AS (
  SELECT conv_id, turn, query, answer, context, repo_url,
         round(CASE WHEN len(cw) = 0 THEN 0.7 ELSE least(1.0, len(list_filter(cw, lambda x: contains(lc, x))) / len(cw) + 0.2) END, 6) AS faithful,
         round(least(1.0, len(list_intersect(qw, aw)) / greatest(len(qw), 1) + 0.3), 6) AS relevant,
         CAST(CASE WHEN length(answer) < 50 THEN 0.3 WHEN length(answer) < 200 THEN 0.6 ELSE 0.9 END AS DOUBLE) AS complete
  FROM content),
scored AS (SELECT *, {tier_sql('score')} AS tier, score >= 0.7 AS sft_ready FROM (
  SELECT *, generation AS score FROM (SELECT *, round(greatest(0.0, 0.35 * faithful + 0.35 * relevant + 0.2 * complete + 0.1), 6) AS generation FROM judged)))"""

KEY = ["conv_id", "turn"]
_talk = [("hi",), ("hello there friend",), ("Hello",), ("tests are red",), ("how does the parser work",), ("你好",), ("什么是 向量索引",), ("",), (None,), ("  OK  ",), ("what is this",), ("can your code",)]


@register("chatty_filter", f"WITH {sql_values('t', 'q string', _talk)}, {QA} SELECT q AS query, {chatty_sql('q')} AS chatty FROM t UNION ALL SELECT query, {chatty_sql('query')} FROM qa")
def chatty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = literals(spark, "query string", _talk).unionByName(qa(spark, sf_dir).select("query"))
    return both.select("query", X.is_chatty(F.col("query")).alias("chatty"))


_code = [("def f(x): pass",), ("no code",), ("```",), ("package main",), ("Class A",), (None,), ("",)]


@register("code_indicator", f"WITH {sql_values('t', 'x string', _code)}, {QA} SELECT x AS text, {code_sql('x')} AS code FROM t UNION ALL SELECT context, {code_sql('context')} FROM qa")
def code_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = literals(spark, "text string", _code).unionByName(qa(spark, sf_dir).select(F.col("context").alias("text")))
    return both.select("text", X.shows_code(F.col("text")).alias("code"))


_cjk = [("abc",), ("向量",), ("mixed 检索 text",), ("ひらがな",), ("",), (None,), ("龦",)]


@register("cjk_detect", f"WITH {sql_values('t', 'x string', _cjk)} SELECT x AS text, coalesce(regexp_matches(x, '[一-鿿]'), false) AS cjk FROM t")
def cjk_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, "text string", _cjk).select("text", X.has_cjk(F.col("text")).alias("cjk"))


ONLINE = f"""CASE WHEN query IS NULL OR trim(query) = '' THEN 'query_empty' WHEN length(trim(query)) < 10 THEN 'query_too_short' WHEN {chatty_sql('query')} THEN 'chatty_query'
  WHEN coalesce(repo_url, '') = '' THEN 'missing_repo_url' WHEN answer IS NULL OR length(trim(answer)) < 100 THEN 'answer_too_short' WHEN NOT {code_sql('context')} THEN 'no_code_in_context' END"""


@register("online_gate", f"WITH {QA} SELECT conv_id, turn, {ONLINE} AS reason FROM qa")
def online_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).select(*KEY, E.online_reason(F.col("query"), F.col("context"), F.col("answer"), F.col("repo_url")).alias("reason"))


_C = config.CLEANING
OFFLINE = f"""CASE WHEN coalesce(query, '') = '' THEN 'missing_query' WHEN answer IS NULL THEN 'missing_generation' WHEN coalesce(repo_url, '') = '' THEN 'missing_repo_url'
  WHEN score < {_C.min_score} THEN 'low_score:' || printf('%.2f', round(score, 2)) WHEN faithful < {_C.min_faithfulness} THEN 'low_faithfulness:' || printf('%.2f', round(faithful, 2))
  WHEN relevant < {_C.min_relevance} THEN 'low_relevance:' || printf('%.2f', round(relevant, 2)) WHEN length(query) < {_C.min_query} THEN 'short_query:' || length(query)
  WHEN length(answer) < {_C.min_answer} THEN 'short_answer:' || length(answer) WHEN length(context) < {_C.min_context} THEN 'short_context:' || length(context)
  WHEN {chatty_sql('query')} THEN 'chatty_query' WHEN NOT {code_sql('context')} THEN 'no_code_in_context' ELSE 'passed' END"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa(spark, sf_dir, found=True)
    return E.scored(pairs, S.found_share(F.col("found"), F.col("content"))).drop("found", "content")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return judged(spark, sf_dir).withColumn("reason", E.offline_reason(c("query"), c("context"), c("answer"), c("repo_url"), c("score"), c("faithful"), c("relevant")))


@register("offline_gate", f"WITH {SCORED} SELECT conv_id, turn, {OFFLINE} AS reason FROM scored")
def offline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select(*KEY, "reason")


@register("rejection_counts", f"WITH {SCORED} SELECT split_part(reason, ':', 1) AS rule, count(*) AS n, count(DISTINCT reason) AS n_reasons FROM (SELECT {OFFLINE} AS reason FROM scored) WHERE reason <> 'passed' GROUP BY 1")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = gated(spark, sf_dir).where("reason <> 'passed'")
    return rejected.groupBy(F.split("reason", ":")[0].alias("rule")).agg(F.count("*").alias("n"), F.count_distinct("reason").alias("n_reasons"))


@register("judge_faithfulness", f"WITH {SCORED} SELECT conv_id, turn, faithful FROM judged")
def judge_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(*KEY, "faithful")


@register("judge_relevance", f"WITH {SCORED} SELECT conv_id, turn, relevant FROM judged")
def judge_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(*KEY, "relevant")


@register("judge_completeness", f"WITH {SCORED} SELECT conv_id, turn, complete FROM judged")
def judge_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(*KEY, "complete")


@register(
    "rewrite_metrics",
    f"""WITH {QA}, w AS (SELECT conv_id, turn, {words_sql('query')} AS a, {words_sql('answer')} AS b FROM qa),
m AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END AS coverage, least(1.0, len(list_filter(b, lambda x: NOT list_contains(a, x))) / greatest(len(a), 1)) AS diversity FROM w)
SELECT conv_id, turn, round(coverage, 6) AS coverage, round(least(1.0, coverage + 0.2), 6) AS preservation, round(diversity, 6) AS diversity, round(0.4 * coverage + 0.4 * least(1.0, coverage + 0.2) + 0.2 * diversity, 6) AS overall FROM m""",
)
def rewrite_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer stands in for a rewritten query."""
    return qa(spark, sf_dir).select(*KEY, *[r6(v).alias(k) for k, v in S.rewrite_metrics(F.col("query"), F.col("answer")).items()])


@register("generation_score", f"WITH {SCORED} SELECT conv_id, turn, faithful, relevant, complete, generation FROM scored")
def generation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(*KEY, "faithful", "relevant", "complete", "generation")


AGENT = f"""{TRACE},
steps AS (SELECT session, count(*) AS steps, count(*) FILTER (step = before) AS redundant, count(*) FILTER (k < 5) AS backtracks, count(*) FILTER (step = 'error') AS errors, arg_max(step, event_id) AS last_step
  FROM (SELECT *, lag(step) OVER (PARTITION BY session ORDER BY event_id) AS before FROM trace) GROUP BY session),
agent AS (SELECT session, steps, redundant, backtracks, CASE WHEN last_step <> 'error' THEN 1.0 ELSE 0.5 END AS selection, CASE WHEN errors = 0 THEN 1.0 ELSE 0.5 END AS parameters,
  greatest(0.0, least(1.0, 1 - redundant / steps - 0.1 * backtracks)) AS efficiency, CASE WHEN last_step <> 'error' THEN 1.0 ELSE 0.0 END AS success FROM steps)"""


def agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent measures of each session: repeated steps, backtracks (k under 5), errors."""
    t = events(spark, sf_dir).withColumn("before", F.lag("step").over(Window.partitionBy("session").orderBy("event_id")))
    g = t.groupBy("session").agg(F.count("*").alias("steps"), F.count_if(F.col("step") == F.col("before")).alias("redundant"), F.count_if(F.col("k") < 5).alias("backtracks"), F.count_if(F.col("step") == "error").alias("errors"), F.max_by("step", "event_id").alias("last_step"))
    ended = F.col("last_step") != "error"
    return g.select(
        "session", "steps", "redundant", "backtracks", F.when(ended, 1.0).otherwise(0.5).alias("selection"), F.when(F.col("errors") == 0, 1.0).otherwise(0.5).alias("parameters"),
        S.efficiency(F.col("steps"), F.col("redundant"), F.col("backtracks")).alias("efficiency"), F.when(ended, 1.0).otherwise(0.0).alias("success"),
    )


@register("agentic_metrics", f"WITH {AGENT} SELECT session, steps, redundant, backtracks, selection, parameters, round(efficiency, 6) AS efficiency, success, round(0.4 * selection + 0.3 * parameters + 0.2 * efficiency + 0.1 * success, 6) AS agentic FROM agent")
def agentic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = agent(spark, sf_dir)
    return a.withColumn("agentic", r6(S.agentic_score(F.col("selection"), F.col("parameters"), F.col("efficiency"), F.col("success")))).withColumn("efficiency", r6("efficiency"))


# Layers of a pair: rewrite where the turn is even, retrieval always, generation, agentic where the session has one.
LAYERED = f"""{SCORED}, {AGENT},
layered AS (
  SELECT s.conv_id, s.turn, CASE WHEN s.turn % 2 = 0 THEN s.relevant END AS rewrite, s.faithful AS retrieval, s.generation AS generation,
         round(0.4 * selection + 0.3 * parameters + 0.2 * efficiency + 0.1 * success, 6) AS agentic
  FROM scored s LEFT JOIN agent a ON a.session = s.conv_id),
overall AS (SELECT *, round(coalesce(
    (coalesce(rewrite * 0.15, 0) + coalesce(retrieval * 0.35, 0) + coalesce(generation * 0.4, 0) + coalesce(agentic * 0.1, 0))
    / (CASE WHEN rewrite IS NULL THEN 0 ELSE 0.15 END + CASE WHEN retrieval IS NULL THEN 0 ELSE 0.35 END + CASE WHEN generation IS NULL THEN 0 ELSE 0.4 END + CASE WHEN agentic IS NULL THEN 0 ELSE 0.1 END), 0), 6) AS overall FROM layered)"""


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, a = judged(spark, sf_dir), agentic_metrics(spark, sf_dir).select("session", "agentic")
    rows = s.join(a, s["conv_id"] == a["session"], "left").select(*KEY, F.when(F.col("turn") % 2 == 0, F.col("relevant")).alias("rewrite"), F.col("faithful").alias("retrieval"), "generation", "agentic")
    return rows.withColumn("overall", r6(S.overall(rewrite=F.col("rewrite"), retrieval=F.col("retrieval"), generation=F.col("generation"), agentic=F.col("agentic"))))


@register("overall_score", f"WITH {LAYERED} SELECT conv_id, turn, rewrite, retrieval, generation, agentic, overall FROM overall")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir)


_bounds = [(0.9,), (0.8999,), (0.7,), (0.6999,), (0.5,), (0.49,), (0.0,), (1.2,), (-0.1,), (0.65,)]


@register("tier_assign", f"WITH {sql_values('t', 's double', _bounds)}, {LAYERED} SELECT score, {tier_sql('score')} AS tier, score >= 0.7 AS sft_ready FROM (SELECT greatest(0.0, least(1.0, s)) AS score FROM t UNION ALL SELECT overall FROM overall)")
def tier_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = literals(spark, "s double", _bounds).unionByName(layered(spark, sf_dir).select(F.col("overall").alias("s"))).select(S.clamp(F.col("s")).alias("score"))
    return s.select("score", S.tier(F.col("score")).alias("tier"), (F.col("score") >= 0.7).alias("sft_ready"))


# The second judge: known for documents with a label, by its quality.
SECOND = f"""{SCORED},
second AS (SELECT s.*, CASE WHEN quality IS NOT NULL THEN round(least(1.0, generation + CASE WHEN quality = 1 THEN 0.25 ELSE -0.125 END), 6) END AS second FROM scored s LEFT JOIN labels ON doc_id = conv_id),
final AS (SELECT *, CASE WHEN second IS NULL OR round(abs(score - second), 9) > 0.2 THEN score ELSE round(0.7 * score + 0.3 * second, 9) END AS final_score,
  CASE WHEN second IS NULL THEN 'normal' WHEN round(abs(score - second), 9) > 0.2 THEN 'needs_review' WHEN score > 0.75 AND second > 0.75 THEN 'high_confidence' ELSE 'normal' END AS status FROM second)"""


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, labels = judged(spark, sf_dir), read(spark, sf_dir, "labels").select("doc_id", "quality")
    second = F.when(F.col("quality").isNotNull(), r6(F.least(F.lit(1.0), F.col("generation") + F.when(F.col("quality") == 1, 0.25).otherwise(-0.125))))
    rows = j.join(labels, j["conv_id"] == labels["doc_id"], "left").withColumn("second", second)
    got = S.final_score(F.col("score"), F.col("second"))
    return rows.withColumn("final_score", got["score"]).withColumn("status", got["status"])


@register("hybrid_final_score", f"WITH {SECOND} SELECT conv_id, turn, score, second, round(final_score, 6) AS final_score, status FROM final")
def hybrid_final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final(spark, sf_dir).select(*KEY, "score", "second", r6("final_score").alias("final_score"), "status")


REVIEW = f"{SECOND}, review AS (SELECT conv_id || '-' || turn AS sample_id, score, second, round(abs(score - second), 6) AS diff, conv_id, turn FROM final WHERE status = 'needs_review')"


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = final(spark, sf_dir).where("status = 'needs_review'")
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"), "score", "second", r6(F.abs(F.col("score") - F.col("second"))).alias("diff"), "conv_id", "turn")


@register("review_queue", f"WITH {REVIEW} SELECT sample_id, score, second, diff FROM review")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review(spark, sf_dir).select("sample_id", "score", "second", "diff")


# Decisions: two a sample at times, of which the first holds; samples without one stay pending.
@register(
    "review_resolution",
    f"""WITH {REVIEW}, d AS (SELECT sample_id, unnest(CASE WHEN conv_id % 4 = 0 THEN ['approve', 'reject'] WHEN conv_id % 4 = 1 THEN ['reject'] WHEN conv_id % 4 = 2 THEN ['approve', 'approve'] ELSE [] END) AS decision,
  unnest([1, 2][1:CASE WHEN conv_id % 2 = 0 THEN 2 WHEN conv_id % 4 = 1 THEN 1 ELSE 0 END]) AS pos FROM review),
f AS (SELECT sample_id, arg_min(decision, pos) AS decision, count(DISTINCT decision) > 1 AS conflict FROM d GROUP BY sample_id)
SELECT r.sample_id, coalesce(decision, 'pending') AS decision, coalesce(conflict, false) AS conflict, coalesce(decision, '') = 'approve' AS routed FROM review r LEFT JOIN f USING (sample_id)""",
)
def review_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = review(spark, sf_dir)
    said = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("approve"), F.lit("reject"))).when(F.col("conv_id") % 4 == 1, F.array(F.lit("reject"))).when(F.col("conv_id") % 4 == 2, F.array(F.lit("approve"), F.lit("approve"))).otherwise(F.array().cast("array<string>"))
    d = r.select("sample_id", F.posexplode(said).alias("at", "decision"))
    first = d.groupBy("sample_id").agg(F.min_by("decision", "at").alias("decision"), (F.count_distinct("decision") > 1).alias("conflict"))
    out = r.join(first, "sample_id", "left")
    return out.select("sample_id", F.coalesce("decision", F.lit("pending")).alias("decision"), F.coalesce("conflict", F.lit(False)).alias("conflict"), F.coalesce(F.col("decision") == "approve", F.lit(False)).alias("routed"))


# Routing: every fifth score comes in as 0 and is computed anew.
ROUTE = f"{SCORED}, routed AS (SELECT conv_id, turn, s AS score, {tier_sql('s')} AS tier FROM (SELECT conv_id, turn, CASE WHEN given = 0 THEN generation ELSE given END AS s FROM (SELECT *, CASE WHEN (conv_id + turn) % 5 = 0 THEN 0.0 ELSE score END AS given FROM scored)))"


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = judged(spark, sf_dir).withColumn("score", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, 0.0).otherwise(F.col("score")))
    return E.routed(given)


@register("route_positive", f"WITH {ROUTE} SELECT conv_id, turn, score, tier FROM routed WHERE tier IN ('gold', 'silver')")
def route_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).where("sink = 'positive'").select(*KEY, "score", "tier")


@register("route_negative", f"WITH {ROUTE} SELECT conv_id, turn, score, tier FROM routed WHERE tier = 'bronze'")
def route_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).where("sink = 'negative'").select(*KEY, "score", "tier")


@register("route_audit", f"WITH {ROUTE} SELECT conv_id, turn, score, tier FROM routed")
def route_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select(*KEY, "score", "tier")


@register("tier_distribution", f"WITH {ROUTE} SELECT t.tier, count(r.tier) AS n FROM (VALUES ('gold'), ('silver'), ('bronze'), ('rejected')) t(tier) LEFT JOIN routed r ON r.tier = t.tier GROUP BY t.tier")
def tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = literals(spark, "tier string", [("gold",), ("silver",), ("bronze",), ("rejected",)])
    counts = routed(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))
    return known.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def smart_sql(t: str, most: str) -> str:
    room, sep = f"({most} - {len(config.ELLIPSIS)})", sql_text(config.ELLIPSIS)
    head = f"CAST(floor({room} * 0.7) AS INTEGER)"
    return f"CASE WHEN length({t}) <= {most} THEN {t} WHEN {room} <= 0 THEN left({t}, {most}) ELSE left({t}, {head}) || {sep} || right({t}, {room} - {head}) END"


_T = config.SFT
INPUT = lambda q, c: f"'[用户问题]' || chr(10) || {q} || chr(10) || chr(10) || '[代码上下文]' || chr(10) || {c}"
SFT = f"""cut AS (SELECT *, CASE WHEN length(query) > {_T.query} THEN left(query, {_T.query}) || '...' ELSE query END AS q_, {smart_sql('context', str(_T.context))} AS c_,
  CASE WHEN length(answer) > {_T.answer} THEN left(answer, {_T.answer}) || {sql_text(config.ANSWER_CUT)} ELSE answer END AS a_ FROM scored),
total AS (SELECT *, length({INPUT('q_', 'c_')}) + length(a_) + {len(config.INSTRUCTION)} AS n_ FROM cut),
sft AS (SELECT *, {INPUT('q_', 'x_')} AS input, a_ AS output, length(context) > {_T.context} OR length(answer) > {_T.answer} AS truncated FROM (
  SELECT *, CASE WHEN n_ > {_T.total} THEN {smart_sql('context', f'greatest(500, length(c_) - (n_ - {_T.total}))')} ELSE c_ END AS x_ FROM total))"""


@register("sft_build", f"WITH {SCORED}, {SFT} SELECT conv_id, turn, input, output, tier, truncated, CAST(length(context) AS BIGINT) AS context_len FROM sft")
def sft_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sft_build(judged(spark, sf_dir)).select(*KEY, "input", "output", "tier", "truncated", F.length("context").cast("long").alias("context_len"))


CLEAN = f"""{SCORED}, clean AS (SELECT conv_id, turn, {INPUT('query', f"CASE WHEN length(context) > {_C.max_context} THEN left(context, {_C.max_context}) || {sql_text(config.TRUNCATED)} ELSE context END")} AS input, answer AS output, tier, score
  FROM scored WHERE {OFFLINE.replace("WHEN NOT " + code_sql('context') + " THEN 'no_code_in_context' ", "")} = 'passed')"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that pass all rules, or all but the one on code in the context (the tables hold prose)."""
    return E.sft_clean(gated(spark, sf_dir).where("reason IN ('passed', 'no_code_in_context')"))


@register("sft_clean", f"WITH {CLEAN} SELECT conv_id, turn, input, output, tier FROM clean")
def sft_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select(*KEY, "input", "output", "tier")


@register("smart_truncate", f"SELECT doc_id, {smart_sql('text', '700')} AS short, {smart_sql('text', '20')} AS tiny FROM documents")
def smart_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.smart_truncate(F.col("text"), 700).alias("short"), X.smart_truncate(F.col("text"), 20).alias("tiny"))


@register("export_alpaca", f"WITH {CLEAN} SELECT conv_id, turn, {sql_text(config.INSTRUCTION)} AS instruction, input, output FROM clean")
def export_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select(*KEY, "instruction", "input", "output")


@register("export_sharegpt", f"WITH {CLEAN} SELECT conv_id, turn, 'human' AS from_1, {sql_text(config.INSTRUCTION)} || chr(10) || chr(10) || input AS value_1, 'gpt' AS from_2, output AS value_2 FROM clean")
def export_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array(F.struct(F.lit("human").alias("from"), F.concat("instruction", F.lit("\n\n"), "input").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("output").alias("value")))
    c = cleaned(spark, sf_dir).select(*KEY, turns.alias("c"))
    return c.select(*KEY, *[F.col("c")[i][f].alias(f"{f}_{i + 1}") for i in (0, 1) for f in ("from", "value")])


@register("export_messages", f"WITH {CLEAN}, m AS (SELECT conv_id, turn, unnest(['system', 'user', 'assistant']) AS role, unnest([{sql_text(config.INSTRUCTION)}, input, output]) AS content, unnest([0, 1, 2]) AS pos FROM clean) SELECT conv_id, turn, pos, role, content FROM m")
def export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in (("system", "instruction"), ("user", "input"), ("assistant", "output"))])
    return cleaned(spark, sf_dir).select(*KEY, F.posexplode(said).alias("pos", "m")).select(*KEY, "pos", "m.role", "m.content")


@register(
    "basic_stats",
    f"""WITH {SCORED} SELECT count(*) AS total, round(avg(score), 6) AS mean, max(score) AS most, min(score) AS least, quantile_disc(score, 0.5 ORDER BY score DESC) AS median,
  count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (tier = 'silver') AS silver, count(*) FILTER (tier = 'bronze') AS bronze, count(*) FILTER (tier = 'rejected') AS rejected, count(*) FILTER (sft_ready) AS sft_ready FROM scored""".replace(
        "quantile_disc(score, 0.5 ORDER BY score DESC)", "list_sort(list(score))[CAST(floor(count(*) / 2) AS INTEGER) + 1]"
    ),
)
def basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.basic_stats(judged(spark, sf_dir))


@register("layer_performance", f"WITH {LAYERED} SELECT layer, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most, count(*) AS n FROM (SELECT unnest(['rewrite', 'retrieval', 'generation', 'agentic']) AS layer, unnest([rewrite, retrieval, generation, agentic]) AS v FROM overall) WHERE v <> 0 GROUP BY layer")
def layer_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.layer_performance(layered(spark, sf_dir), ["rewrite", "retrieval", "generation", "agentic"])


# Bad cases: score under 0.6. Hit and recall stand in from the pair's own measures.
BAD = f"""{SCORED}, bad AS (
  SELECT conv_id, turn, score, list_filter([CASE WHEN relevant <= 0.3 THEN 'retrieval_failure' WHEN relevant < 0.5 THEN 'retrieval_low_recall' END, CASE WHEN faithful < 0.5 THEN 'generation_hallucination' END,
    CASE WHEN complete < 0.4 THEN 'generation_incomplete' END, CASE WHEN length(answer) % 7 = 0 THEN 'hallucination_detected' END, CASE WHEN conv_id % 6 = 0 THEN 'agentic_failure' END], lambda r: r IS NOT NULL) AS reasons
  FROM scored WHERE score < 0.6)"""


def bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).where(F.coalesce("score", F.lit(1.0)) < 0.6)
    hit = F.when(F.col("relevant") <= 0.3, 0).otherwise(1)
    reasons = E.failure_reasons(hit, F.col("relevant"), F.col("faithful"), F.col("complete"), F.when(F.length("answer") % 7 == 0, 1).otherwise(0), F.col("conv_id") % 6 != 0)
    return rows.withColumn("reasons", reasons)


@register("failure_categories", f"WITH {BAD} SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['unknown'] ELSE reasons END) AS reason FROM bad) GROUP BY reason")
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("failure_examples", f"WITH {BAD} SELECT reason, conv_id, turn, rank FROM (SELECT reason, conv_id, turn, row_number() OVER (PARTITION BY reason ORDER BY conv_id, turn) AS rank FROM (SELECT conv_id, turn, unnest(CASE WHEN len(reasons) = 0 THEN ['unknown'] ELSE reasons END) AS reason FROM bad)) WHERE rank <= 3")
def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three examples of each reason, as the report shows them."""
    rows = bad(spark, sf_dir).select(*KEY, F.explode("reasons").alias("reason"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("reason").orderBy("conv_id", "turn")).cast("long")).where("rank <= 3").select("reason", *KEY, "rank")


@register("recommendations", f"WITH {LAYERED} SELECT coalesce(avg(retrieval) FILTER (retrieval <> 0) < 0.7, false) AS retrieval_low, coalesce(avg(generation) FILTER (generation <> 0) < 0.7, false) AS generation_low, coalesce(avg(rewrite) FILTER (rewrite <> 0) < 0.6, false) AS rewrite_low, count(*) FILTER (overall >= 0.7) / greatest(count(*), 1) < 0.5 AS too_little_data FROM overall")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = lambda c, least: F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))) < least, F.lit(False)).alias(f"{c}_low")
    return layered(spark, sf_dir).agg(low("retrieval", 0.7), low("generation", 0.7), low("rewrite", 0.6), (F.count_if(F.col("overall") >= 0.7) / F.greatest(F.count("*"), F.lit(1)) < 0.5).alias("too_little_data"))


@register("top_issues", f"WITH {SCORED} SELECT reason, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, reason) AS rank FROM (SELECT {OFFLINE} AS reason, count(*) AS n FROM scored GROUP BY 1)) WHERE rank <= 5")
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = gated(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "reason")).cast("long"))


@register("bad_cases", f"WITH {BAD} SELECT conv_id, turn, score FROM bad ORDER BY score, conv_id, turn")
def bad_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad(spark, sf_dir).select(*KEY, "score").orderBy("score", *KEY)


@register("bad_samples", f"WITH {SCORED} SELECT conv_id, turn, score FROM scored WHERE coalesce(score, 0) < 0.6 ORDER BY conv_id, turn LIMIT 20")
def bad_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in file order under the bound (a report of fixed length), then by score."""
    return judged(spark, sf_dir).where(F.coalesce("score", F.lit(0.0)) < 0.6).select(*KEY, "score").orderBy(*KEY).limit(20).orderBy("score", *KEY)


GOLDEN = """golden AS (
  SELECT item_id, 'sample_' || lpad(CAST(item_id AS VARCHAR), 4, '0') AS id, text AS query, CASE WHEN item_id % 3 = 0 THEN 'easy' WHEN item_id % 3 = 1 THEN 'medium' ELSE 'hard' END AS difficulty,
         CASE WHEN item_id % 2 = 0 THEN 'architecture' ELSE 'detail' END AS category, CASE WHEN item_id % 7 = 0 THEN 'zh' ELSE 'en' END AS language,
         CASE WHEN item_id % 5 = 0 THEN '' ELSE left(text, 20) END AS expected_answer, CASE WHEN item_id % 11 = 0 THEN '' ELSE 'src/' || item_id || '.py' END AS expected_file FROM benchmark)"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return read(spark, sf_dir, "benchmark").select(
        "item_id", F.format_string("sample_%04d", i).alias("id"), F.col("text").alias("query"), F.when(i % 3 == 0, "easy").when(i % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
        F.when(i % 2 == 0, "architecture").otherwise("detail").alias("category"), F.when(i % 7 == 0, "zh").otherwise("en").alias("language"),
        F.when(i % 5 == 0, "").otherwise(F.left(F.col("text"), F.lit(20))).alias("expected_answer"), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("src/"), i, F.lit(".py"))).alias("expected_file"),
    )


@register("golden_stats", f"WITH {GOLDEN} SELECT coalesce(category, '') AS category, coalesce(difficulty, '') AS difficulty, coalesce(language, '') AS language, count(*) AS n FROM golden GROUP BY GROUPING SETS ((category), (difficulty), (language))")
def golden_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = golden(spark, sf_dir)
    sets = g.groupingSets([[F.col("category")], [F.col("difficulty")], [F.col("language")]], "category", "difficulty", "language").agg(F.count("*").alias("n"))
    return sets.fillna("", ["category", "difficulty", "language"])


@register(
    "golden_validate",
    f"""WITH {GOLDEN} SELECT 'empty_query' AS issue, id FROM golden WHERE trim(query) = '' UNION ALL SELECT 'empty_files', id FROM golden WHERE expected_file = '' UNION ALL SELECT 'empty_expected_answer', id FROM golden WHERE trim(expected_answer) = ''
UNION ALL SELECT 'language_distribution', l FROM (VALUES ('zh'), ('en')) v(l) WHERE (SELECT count(*) FROM golden WHERE language = l) < 5 UNION ALL SELECT 'difficulty_distribution', d FROM (VALUES ('easy'), ('medium'), ('hard')) v(d) WHERE (SELECT count(*) FROM golden WHERE difficulty = d) < 5""",
)
def golden_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of single samples, and the strict floors of five samples for each language and difficulty."""
    g = golden(spark, sf_dir)
    checks = F.array(
        F.when(F.trim("query") == "", "empty_query"), F.when(F.col("expected_file") == "", "empty_files"), F.when(F.trim("expected_answer") == "", "empty_expected_answer")
    )
    found = g.select("id", F.explode(F.array_compact(checks)).alias("issue"))
    for column, values in (("language", ("zh", "en")), ("difficulty", ("easy", "medium", "hard"))):
        floor = literals(g.sparkSession, "id string", [(v,) for v in values]).join(g.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")), "id", "left")
        found = found.unionByName(floor.where("coalesce(n, 0) < 5").select("id", F.lit(f"{column}_distribution").alias("issue")))
    return found


@register("golden_dups", f"WITH d AS (SELECT conv_id, turn, text AS query, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM conversations WHERE role = 'user') SELECT conv_id, turn, row_number() OVER (PARTITION BY query ORDER BY conv_id, turn) > 1 AS duplicate, row_number() OVER (PARTITION BY norm ORDER BY conv_id, turn) > 1 AS normalized_duplicate FROM d")
def golden_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), X.normalize_query(F.col("text")).alias("norm"))
    seen = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("conv_id", "turn")) > 1
    return q.select("conv_id", "turn", seen("query").alias("duplicate"), seen("norm").alias("normalized_duplicate"))


@register("ragas_columns", f"WITH {GOLDEN} SELECT item_id AS pos, query AS question, expected_answer AS answer, expected_file AS contexts, expected_answer AS ground_truth FROM golden")
def ragas_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four parallel columns of the export, with the position of each sample."""
    return golden(spark, sf_dir).select(F.col("item_id").alias("pos"), F.col("query").alias("question"), F.col("expected_answer").alias("answer"), F.array_join(F.array("expected_file"), "\n").alias("contexts"), F.col("expected_answer").alias("ground_truth"))


@register("golden_filters", f"WITH {GOLDEN} SELECT item_id, category, difficulty FROM golden WHERE query <> '' AND expected_file <> '' AND (category = 'detail' OR difficulty = 'hard')")
def golden_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = golden(spark, sf_dir).where("query <> '' AND expected_file <> ''")
    return g.where((F.col("category") == "detail") | (F.col("difficulty") == "hard")).select("item_id", "category", "difficulty")


@register("score_means", f"WITH {SCORED} SELECT conv_id, round(avg(faithful), 6) AS vector_mean, round(avg(relevant), 6) AS bm25_mean, count(*) AS n FROM scored GROUP BY conv_id")
def score_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy("conv_id").agg(r6(F.avg("faithful")).alias("vector_mean"), r6(F.avg("relevant")).alias("bm25_mean"), F.count("*").alias("n"))
