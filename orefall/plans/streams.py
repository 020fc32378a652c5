"""Queries of the streaming operators; the oracle is the batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.operators import state as T
from orefall.plans.registry import register
from orefall.plans.views import TRACE, events
from orefall.streaming import flows


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.event_stream(spark, f"{sf_dir}/events.parquet")


@register("stream_dedupe", f"WITH {TRACE} SELECT DISTINCT session, k FROM trace")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.dedupe(stream(spark, sf_dir), ["session", "k"]).select("session", "k")


@register("stream_queue", f"WITH {TRACE} SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) <= 10 AS accepted FROM trace")
def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.bounded_queue(stream(spark, sf_dir)).select("event_id", "accepted")


@register("stream_trace_rollup", f"WITH {TRACE} SELECT strftime(ts, '%Y-%m-%d') AS day, step, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM trace GROUP BY 1, 2")
def stream_trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows over the trace."""
    return flows.rollup(stream(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "step", "n", "total")


ERRORS = "step = 'error'"
FAILING = "step IN ('error', 'view', 'click', 'signup')"
DAY = "strftime(ts, '%Y-%m-%d')"


def breaker_sql(key: str, threshold: int, seconds: int, bad: str) -> str:
    """CTE walk (key, event_id, n, run, until, allowed): the breaker's state after each event, one event of all keys a round."""
    still = "w.until IS NOT NULL AND o.ts < w.until"
    run = f"CASE WHEN {still} THEN w.run WHEN o.bad THEN (CASE WHEN w.until IS NULL THEN w.run ELSE 0 END) + 1 ELSE 0 END"
    until = f"CASE WHEN {still} THEN w.until WHEN {run} >= {threshold} THEN o.ts + INTERVAL {seconds} SECOND END"
    return f"""o AS (SELECT {key} AS key, event_id, ts, {bad} AS bad, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM trace),
walk AS (
  SELECT key, event_id, n, CASE WHEN bad THEN 1 ELSE 0 END AS run, CASE WHEN bad AND {threshold} <= 1 THEN ts + INTERVAL {seconds} SECOND END AS until, true AS allowed FROM o WHERE n = 1
  UNION ALL SELECT o.key, o.event_id, o.n, {run}, {until}, NOT coalesce({still}, false) FROM walk w JOIN o ON o.key = w.key AND o.n = w.n + 1)"""


@register("stream_breaker", f"WITH RECURSIVE {TRACE}, {breaker_sql('session', 3, 86400, ERRORS)} SELECT key AS session, event_id FROM walk WHERE allowed AND run >= 3")
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three errors of a session in a row turn its events away for a day."""
    return flows.breaker(stream(spark, sf_dir), 3, 86_400.0).select("session", "event_id")


# Each day is a service whose events fail or not; five failures in a row close it for an hour.
@register("breaker_window", f"WITH RECURSIVE {TRACE}, {breaker_sql(DAY, 5, 3600, FAILING)} SELECT key AS day, event_id, allowed, CAST(run AS INTEGER) AS failures FROM walk")
def breaker_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("step").isin("error", "view", "click", "signup").alias("bad"))
    return T.breaker(e, "day", "ts", "event_id", "bad", 5, 3600.0)
