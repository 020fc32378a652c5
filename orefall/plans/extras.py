"""Queries of smaller operators: commit scans, run endings, judge contexts, metric payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.functions import replies as P
from orefall.functions import scores as S
from orefall.plans.evaluation import QA
from orefall.plans.registry import register
from orefall.plans.views import ISS, TRACE, events, issues, literals, qa, sql_values


@register("commit_scan", f"WITH {ISS} SELECT left(md5(CAST(number AS VARCHAR)), 7) AS sha, title AS message, CASE WHEN number % 3 = 0 THEN 'unknown' ELSE body END AS author FROM (SELECT * FROM iss ORDER BY updated DESC, number LIMIT 90)")
def commit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of 30 (a report of fixed length): short ids, and a default for authors that are not known."""
    page = issues(spark, sf_dir).orderBy(F.desc("updated"), "number").limit(90)
    author = F.when(F.col("number") % 3 != 0, F.col("body"))
    return page.select(F.substring(F.md5(F.col("number").cast("string")), 1, 7).alias("sha"), F.col("title").alias("message"), F.coalesce(author, F.lit("unknown")).alias("author"))


@register("commit_scan_since", f"WITH {ISS} SELECT number, updated FROM iss WHERE updated >= '1998-06-01T00:00:00Z'")
def commit_scan_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).where("updated >= '1998-06-01T00:00:00Z'").select("number", "updated")


# Endings: the metadata of a session's events, each replacing the keys that it sets.
@register("run_finish", f"WITH {TRACE}, m AS (SELECT session, step, arg_max(k, event_id) AS k FROM trace GROUP BY session, step) SELECT session, string_agg(step || '=' || k, ',' ORDER BY step) AS metadata FROM m GROUP BY session")
def run_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shallow merge: of each key the last value."""
    last = events(spark, sf_dir).groupBy("session", "step").agg(F.max_by("k", "event_id").alias("k"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "step", F.col("k").cast("string"))))
    return last.groupBy("session").agg(F.array_join(pairs, ",").alias("metadata"))


@register("auto_runs", f"WITH {TRACE}, known AS (SELECT DISTINCT session FROM trace WHERE step = 'signup' AND k < 10) SELECT session, 'unknown' AS name, count(*) AS n_steps FROM trace WHERE session NOT IN (SELECT session FROM known) GROUP BY session")
def auto_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that steps create because none was started."""
    t = events(spark, sf_dir)
    orphans = t.join(t.where("step = 'signup' AND k < 10").select("session").distinct(), "session", "left_anti")
    return orphans.groupBy("session").agg(F.lit("unknown").alias("name"), F.count("*").alias("n_steps"))


@register("run_lookup", f"WITH {TRACE} SELECT event_id, step, k FROM trace WHERE session = 7")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of one run, in order."""
    return events(spark, sf_dir).where("session = 7").select("event_id", "step", "k").orderBy("event_id")


# The judge's context: around up to five identifiers of the answer, 300 before and 700 after the first occurrence; else the head.
_JUDGE = 600


def judge_context_column(context, answer):
    terms = F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.substring(answer, 1, 500), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda t: F.length(t) > 3)), 1, 5)
    at = F.filter(F.transform(terms, lambda t: F.call_function("instr", context, t)), lambda p: p > 0)
    parts = F.array_distinct(F.transform(at, lambda p: context.substr(F.greatest(F.lit(1), p - 300), F.least(p - 1, F.lit(300)) + 700)))
    return F.when(F.length(context) <= _JUDGE, context).when(F.size(parts) == 0, F.substring(context, 1, _JUDGE)).otherwise(F.array_join(parts, "\n...\n"))


@register(
    "judge_context",
    f"""WITH {QA}, t AS (SELECT conv_id, turn, context, list_filter(regexp_extract_all(left(answer, 500), '[A-Za-z_][A-Za-z0-9_]*'), lambda t: length(t) > 3) AS l FROM qa),
d AS (SELECT *, list_filter(l, lambda t, i: list_position(l, t) = i)[1:5] AS terms FROM t),
p AS (SELECT *, list_filter(list_transform(terms, lambda t: strpos(context, t)), lambda p: p > 0) AS at_ FROM d),
s AS (SELECT *, list_transform(at_, lambda p: substr(context, greatest(1, p - 300), least(p - 1, 300) + 700)) AS raw FROM p)
SELECT conv_id, turn, CASE WHEN length(context) <= {_JUDGE} THEN context WHEN len(raw) = 0 THEN left(context, {_JUDGE}) ELSE array_to_string(list_filter(raw, lambda x, i: list_position(raw, x) = i), chr(10) || '...' || chr(10)) END AS shown FROM s""",
)
def judge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an external judge is shown of a long context (the bound is small here so that it matters)."""
    return qa(spark, sf_dir).select("conv_id", "turn", judge_context_column(F.col("context"), F.col("answer")).alias("shown"))


_metrics = [(1, '{"faithfulness": 0.5, "odd": 1}', 0.5, None), (2, '{"answer_relevance": 1}', None, 1.0), (3, "bad", None, None), (4, None, None, None)]
_M = "id int, payload string, faithfulness double, relevance double"


@register("metric_parse", f"WITH {sql_values('t', _M, _metrics)} SELECT id, faithfulness, relevance FROM t")
def metric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known fields of a payload; others are dropped, what is not readable is null."""
    got = literals(spark, _M, _metrics).select("id", F.from_json("payload", "faithfulness double, answer_relevance double").alias("m"))
    return got.select("id", "m.faithfulness", F.col("m.answer_relevance").alias("relevance"))


_tiers = [("gold", 0.9), ("silver", 0.7), ("bronze", 0.5), ("rejected", 0.0), ("odd", 0.0)]


@register("tier_floor", f"WITH {sql_values('t', 'tier string, floor double', _tiers)} SELECT tier, floor FROM t")
def tier_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, "tier string, expected double", _tiers).select("tier", S.tier_floor(F.col("tier")).alias("floor"))


_values = [(1, 0.3, None, 0.5, 0.3), (2, None, None, 0.5, 0.5), (3, None, 0.2, 0.5, 0.2)]


@register("first_metric", f"WITH {sql_values('t', 'id int, a double, b double, c double, expected double', _values)} SELECT id, expected AS value FROM t")
def first_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three result shapes that has a value."""
    return literals(spark, "id int, a double, b double, c double, expected double", _values).select("id", P.first_present(F.col("a"), F.col("b"), F.col("c")).alias("value"))
