"""Queries of artifacts, traces, memory, dedupe, eviction and queues, over documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefall.functions import ids
from orefall.functions.scores import r6
from orefall.operators import state as T
from orefall.plans.registry import register
from orefall.plans.views import DOCS, TRACE, docs, events, literals, read, sql_values

# Artifacts: documents as writes of (source, lang), the id being the time.
@register("artifact_latest", f"WITH {DOCS} SELECT source AS session, lang AS language, arg_max(md5(text), doc_id) AS payload, max(doc_id) AS generated_at FROM docs GROUP BY source, lang")
def artifact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select(F.col("source").alias("session"), F.col("lang").alias("language"), F.md5("text").alias("payload"), "doc_id")
    return T.latest(d.withColumn("generated_at", F.col("doc_id")), ["session", "language"], "doc_id", "payload", "generated_at")


@register("artifact_languages", f"WITH {DOCS} SELECT source AS session, string_agg(lang, ',' ORDER BY lang) AS languages FROM (SELECT DISTINCT source, lang FROM docs) GROUP BY source")
def artifact_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy(F.col("source").alias("session")).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@register("score_join", f"WITH {DOCS}, core AS (SELECT source, max(doc_id) AS core FROM docs WHERE lang = 'en' GROUP BY source), loc AS (SELECT source, lang, max(doc_id) AS localized FROM docs WHERE lang <> 'en' GROUP BY source, lang) SELECT source AS session, lang AS language, core, localized FROM core JOIN loc USING (source)")
def score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score exists only where core and localized part do."""
    d = docs(spark, sf_dir)
    core = d.where("lang = 'en'").groupBy("source").agg(F.max("doc_id").alias("core"))
    localized = d.where("lang <> 'en'").groupBy("source", "lang").agg(F.max("doc_id").alias("localized"))
    return core.join(localized, "source").select(F.col("source").alias("session"), F.col("lang").alias("language"), "core", "localized")


@register("report_get", f"WITH {DOCS}, r AS (SELECT source, lang, arg_max(md5(text), doc_id) AS report FROM docs GROUP BY source, lang), legacy AS (SELECT source, arg_max(md5(text), doc_id) AS report, arg_max(lang, doc_id) AS lang FROM docs GROUP BY source), asked AS (SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM docs) s CROSS JOIN (VALUES ('en'), ('de'), ('zh')) l(lang)) SELECT a.source AS session, a.lang AS language, coalesce(r.report, CASE WHEN legacy.lang = a.lang THEN legacy.report END) AS report FROM asked a LEFT JOIN r USING (source, lang) LEFT JOIN legacy ON legacy.source = a.source")
def report_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report in the language asked, else the single one of old if it is in that language."""
    d = docs(spark, sf_dir).withColumn("report", F.md5("text"))
    own = T.latest(d, ["source", "lang"], "doc_id", "report")
    legacy = d.groupBy("source").agg(F.max_by("report", "doc_id").alias("old"), F.max_by("lang", "doc_id").alias("old_lang"))
    asked = legacy.crossJoin(F.broadcast(literals(spark, "lang string", [("en",), ("de",), ("zh",)])))
    out = asked.join(own, ["source", "lang"], "left")
    return out.select(F.col("source").alias("session"), F.col("lang").alias("language"), F.coalesce("report", F.when(F.col("old_lang") == F.col("lang"), F.col("old"))).alias("report"))


@register("run_fold", f"WITH {TRACE} SELECT session, min(ts) AS started_at, max(ts) AS updated_at, arg_max(step, event_id) AS status, arg_max(k, event_id) AS last_k, count(*) AS n_events FROM trace GROUP BY session")
def run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.fold_runs(events(spark, sf_dir))
    return runs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "updated_at")})


_meta = [('{"status": " Running "}', "running"), ('{"status": "odd"}', "completed"), ('{"stream_completed": false}', "failed"), ('{"error": "x"}', "failed"), ('{"error": ""}', "completed"), ('{"exception": "boom"}', "failed"), ("{}", "completed"), (None, "completed"), ('{"status": "cancelled", "error": "x"}', "cancelled")]


@register("run_status", f"WITH {sql_values('t', 'meta string, expected string', _meta)} SELECT meta, expected AS status FROM t")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, "meta string, expected string", _meta).select("meta", T.run_status(F.col("meta")).alias("status"))


_steps = [("tool_error", "{}", "error"), ("Failed run", None, "error"), ("step", '{"error": "x"}', "error"), ("step", '{"success": false}', "error"), ("finish", "{}", "completed"), ("all done", '{"success": true}', "completed"), ("start", "{}", "info"), (None, None, "info")]


@register("step_status", f"WITH {sql_values('t', 'name string, data string, expected string', _steps)} SELECT name, data, expected AS status FROM t")
def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, "name string, data string, expected string", _steps).select("name", "data", T.step_status(F.col("name"), F.col("data")).alias("status"))


@register("stream_event_status", f"WITH {TRACE} SELECT event_id, CASE WHEN step = 'error' THEN 'error' WHEN step IN ('finish', 'complete', 'completed') THEN 'completed' ELSE 'info' END AS status FROM trace")
def stream_event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", T.event_step_status(F.col("step")).alias("status"))


@register("tool_latency", f"WITH {TRACE} SELECT step, count(*) AS n, round(avg(latency), 6) AS mean, max(latency) AS most, sum(k) AS tokens, CASE WHEN sum(latency) = 0 THEN NULL ELSE round(sum(k) / sum(latency) + 1e-9, 2) END AS per_second FROM trace GROUP BY step")
def tool_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = F.round(F.try_divide(F.sum("k"), F.sum("latency")) + 1e-9, 2)
    return events(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n"), r6(F.avg("latency")).alias("mean"), F.max("latency").alias("most"), F.sum("k").alias("tokens"), per.alias("per_second"))


@register("trace_join", f"WITH {TRACE}, runs AS (SELECT session, min(event_id) AS run_id FROM trace GROUP BY session) SELECT run_id, step, count(*) AS n FROM trace JOIN runs USING (session) GROUP BY run_id, step")
def trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir)
    return t.join(t.groupBy("session").agg(F.min("event_id").alias("run_id")), "session").groupBy("run_id", "step").agg(F.count("*").alias("n"))


@register("trace_log_counts", f"WITH {TRACE} SELECT step AS log_type, strftime(ts, '%Y%m%d') AS day, count(*) AS n FROM trace GROUP BY 1, 2")
def trace_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("step").alias("log_type"), F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"))


@register("memory_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4")
def memory_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memory_window(read(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


@register("memory_summary_segment", "WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations) SELECT conv_id, turn, n - conv_id % 2 > 4 AS due FROM c WHERE seq >= conv_id % 2 AND seq < n - 2")
def memory_summary_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one turn kept, two the threshold, and a marker at 0 or 1."""
    s = T.to_summarise(read(spark, sf_dir, "conversations"), 1, F.col("conv_id") % 2)
    return s.select("conv_id", "turn", (F.col("n") - F.col("conv_id") % 2 > 4).alias("due"))


@register("prompt_history", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, CASE WHEN max(n) <= 2 THEN '' ELSE coalesce(string_agg(CASE WHEN back BETWEEN 2 AND 7 THEN role || ': ' || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END END, chr(10) ORDER BY turn), '') END AS history FROM c GROUP BY conv_id")
def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six messages before the current one, each cut at 500; nothing for two messages or fewer."""
    w = Window.partitionBy("conv_id")
    c = read(spark, sf_dir, "conversations").withColumn("n", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("turn"))))
    line = F.concat("role", F.lit(": "), F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text")))
    lines = F.array_sort(F.collect_list(F.when(F.col("back").between(2, 7), F.struct("turn", line.alias("line")))))
    return c.groupBy("conv_id").agg(F.when(F.max("n") <= 2, "").otherwise(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("history"))


@register("conversation_stats", "SELECT conv_id, count(*) AS messages, CAST(floor(count(*) / 2) AS BIGINT) AS turns, count(*) FILTER (role = 'system') > 0 AS has_summary FROM conversations GROUP BY conv_id")
def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.floor(F.count("*") / 2).alias("turns"), (F.count_if(F.col("role") == "system") > 0).alias("has_summary"))


@register("memory_stats", "SELECT count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM conversations")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("sessions"), F.count("*").alias("messages"))


@register("summary_merge", "SELECT conv_id, string_agg(left(text, 40), chr(10) || chr(10) ORDER BY turn) AS summary, max(turn) + 1 AS up_to FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def summary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role <> 'user'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 40).alias("s")))), lambda x: x["s"])
    return c.groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("summary"), (F.max("turn") + 1).alias("up_to"))


@register("manager_stats", f"WITH {TRACE}, m AS (SELECT max(ts) AS now_ FROM trace) SELECT session, round(date_diff('second', min(date_trunc('second', ts)), any_value(date_trunc('second', now_))) / 3600 + 1e-9, 2) AS age_hours, round(date_diff('second', max(date_trunc('second', ts)), any_value(date_trunc('second', now_))) / 60 + 1e-9, 2) AS idle_minutes FROM trace CROSS JOIN m GROUP BY session")
def manager_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir)
    now = F.broadcast(t.agg(F.unix_timestamp(F.max("ts")).alias("now_")))
    s = t.groupBy("session").agg(F.unix_timestamp(F.min("ts")).alias("a"), F.unix_timestamp(F.max("ts")).alias("b")).crossJoin(now)
    return s.select("session", F.round((F.col("now_") - F.col("a")) / 3600 + 1e-9, 2).alias("age_hours"), F.round((F.col("now_") - F.col("b")) / 60 + 1e-9, 2).alias("idle_minutes"))


@register("embed_stats", "SELECT count(*) AS total, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS failed, count(DISTINCT len(embedding)) AS dims, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings")
def embed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("embedding")
    return read(spark, sf_dir, "embeddings").agg(F.count("*").alias("total"), F.count_if(F.col("embedding").isNull() | (n == 0)).alias("failed"), F.count_distinct(n).alias("dims"), F.max(n).alias("dim"))


@register("dedupe_keys", f"WITH {TRACE} SELECT session, k, min(event_id) AS event_id FROM trace GROUP BY session, k")
def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each (session, k)."""
    return T.first_of(events(spark, sf_dir).select("session", "k", "event_id"), ["session", "k"], "event_id")


@register("dedupe_anti", f"WITH {TRACE}, done AS (SELECT DISTINCT session, k FROM trace WHERE step = 'purchase') SELECT event_id, session, k FROM trace t WHERE step = 'view' AND NOT EXISTS (SELECT 1 FROM done d WHERE d.session = t.session AND d.k = t.k)")
def dedupe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir)
    return t.where("step = 'view'").join(t.where("step = 'purchase'").select("session", "k").distinct(), ["session", "k"], "left_anti").select("event_id", "session", "k")


@register("fifo_eviction", f"WITH {TRACE}, n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS total FROM trace) SELECT event_id FROM n WHERE i >= CASE WHEN total <= 1000 THEN 0 ELSE 1001 + floor((total - 1001) / 501) * 501 - 500 END")
def fifo_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fifo_kept(events(spark, sf_dir).select("event_id"), "event_id")


@register("lru_evict", f"WITH {TRACE} SELECT session, max(event_id) AS last_used FROM trace GROUP BY session ORDER BY last_used DESC, session LIMIT 100")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lru_kept(events(spark, sf_dir), "session", "event_id")


@register("idle_cleanup", f"WITH {TRACE}, m AS (SELECT max(ts) AS now_ FROM trace), s AS (SELECT session, max(ts) AS last_ FROM trace GROUP BY session) SELECT session FROM s CROSS JOIN m WHERE date_diff('second', date_trunc('second', last_), date_trunc('second', now_)) >= 3600")
def idle_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir)
    now = F.broadcast(t.agg(F.unix_timestamp(F.max("ts")).alias("now_")))
    return t.groupBy("session").agg(F.unix_timestamp(F.max("ts")).alias("b")).crossJoin(now).where(F.col("now_") - F.col("b") >= 3600).select("session")


# Queue: an hour is a batch of the queue, which takes ten tasks.
QUEUE = f"{TRACE}, queued AS (SELECT event_id, date_trunc('hour', ts) AS hour, latency, step, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) AS position FROM trace)"


def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    return T.admitted(t, "hour", "event_id", 10)


@register("queue_admission", f"WITH {QUEUE} SELECT event_id, position, position <= 10 AS accepted FROM queued")
def queue_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queued(spark, sf_dir).select("event_id", F.col("position").cast("long").alias("position"), "accepted")


@register("queue_metrics", f"WITH {QUEUE} SELECT count(*) AS enqueued, count(*) FILTER (position <= 10) AS accepted, count(*) FILTER (position > 10) AS dropped, count(*) FILTER (position <= 10 AND step = 'error') AS failed, max(latency) FILTER (position <= 10) AS most_wait, round(sum(latency) FILTER (position <= 10), 6) AS wait_sum, count(*) FILTER (position <= 10) = count(*) FILTER (position <= 10 AND step IS NOT NULL) AS is_idle FROM queued")
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, ok = queued(spark, sf_dir), F.col("accepted")
    return q.agg(
        F.count("*").alias("enqueued"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("dropped"), F.count_if(ok & (F.col("step") == "error")).alias("failed"),
        F.max(F.when(ok, F.col("latency"))).alias("most_wait"), r6(F.sum(F.when(ok, F.col("latency")))).alias("wait_sum"), (F.count_if(ok) == F.count_if(ok & F.col("step").isNotNull())).alias("is_idle"),
    )


@register("sampling")
def sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the sessions, by hash (a sampling operator)."""
    return events(spark, sf_dir).where(T.sampled(F.col("session"), 0.1)).select("event_id", "session")


@register("breaker_islands", f"WITH {TRACE}, g AS (SELECT session, event_id, CASE WHEN step IN ('error', 'view', 'click') THEN 1 ELSE 0 END AS f, sum(CASE WHEN step IN ('error', 'view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY event_id) AS g FROM trace) SELECT session, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g WHERE f = 1 GROUP BY session, g HAVING count(*) >= 5")
def breaker_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.breaker_islands(events(spark, sf_dir), "session", "event_id", F.col("step").isin("error", "view", "click"))


@register("breaker_hook", f"WITH {TRACE}, g AS (SELECT session, event_id, step, sum(CASE WHEN step = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY event_id) AS g FROM trace) SELECT event_id, count(*) FILTER (step = 'error') OVER (PARTITION BY session, g ORDER BY event_id) AS consecutive FROM g")
def breaker_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many failures in a row each event leaves behind."""
    w = Window.partitionBy("session").orderBy("event_id")
    t = events(spark, sf_dir).withColumn("g", F.sum(F.when(F.col("step") == "error", 0).otherwise(1)).over(w))
    return t.select("event_id", F.count_if(F.col("step") == "error").over(Window.partitionBy("session", "g").orderBy("event_id")).alias("consecutive"))


@register("state_reload", f"WITH {TRACE}, v AS (SELECT event_id, CAST(session AS VARCHAR) || ':' || k AS key, row_number() OVER (ORDER BY event_id DESC) AS back, count(*) OVER () AS total FROM trace WHERE k IS NOT NULL AND step <> 'error') SELECT event_id, key FROM v WHERE total <= 1000 OR back <= 500")
def state_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted keys as they are loaded: bad rows out, over 1000 the newest 500."""
    rows = events(spark, sf_dir).where("k IS NOT NULL AND step <> 'error'").select("event_id", F.concat_ws(":", F.col("session").cast("string"), F.col("k").cast("string")).alias("key"))
    newest = rows.orderBy(F.desc("event_id")).limit(500)
    few = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).where("total <= 1000").drop("total")
    return few.unionByName(newest).distinct()


# A signup opens a trace of its session; what comes before the first belongs to none. Kinds are those of the recorders.
SCOPED = f"""{TRACE}, numbered AS (SELECT *, count(*) FILTER (step = 'signup') OVER (PARTITION BY session ORDER BY event_id) AS run FROM trace),
scoped AS (SELECT *, session || ':' || run AS trace_id, CASE step WHEN 'signup' THEN 'trace_start' WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'error' ELSE 'step' END AS kind FROM numbered WHERE run > 0)"""


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("step") == "signup", "trace_start").when(F.col("step") == "purchase", "tool").when(F.col("step") == "error", "error").otherwise("step")
    return T.traced(events(spark, sf_dir), "session", "event_id", F.col("step") == "signup").withColumn("kind", kind)


@register("trace_scope", f"WITH {SCOPED} SELECT event_id, trace_id, first_value(event_id) OVER (PARTITION BY trace_id ORDER BY event_id) AS opened_by FROM scoped")
def trace_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row carries the trace that was open, and what opened it."""
    return scoped(spark, sf_dir).select("event_id", "trace_id", F.min("event_id").over(Window.partitionBy("trace_id")).alias("opened_by"))


@register("trace_events", f"WITH {SCOPED} SELECT trace_id, kind, count(*) AS n, min(event_id) AS first, max(event_id) AS last, round(sum(latency), 6) AS total FROM scoped GROUP BY trace_id, kind UNION ALL SELECT trace_id, 'trace_end', 1, max(event_id), max(event_id), round(sum(latency), 6) FROM scoped GROUP BY trace_id")
def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the recorders kept of each trace, with an end behind its last row."""
    rows = scoped(spark, sf_dir)
    ended = rows.unionByName(rows.withColumn("kind", F.lit("trace_end")))
    end = F.col("kind") == "trace_end"
    kept = ended.groupBy("trace_id", "kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), r6(F.sum("latency")).alias("total"))
    return kept.select("trace_id", "kind", F.when(end, 1).otherwise(F.col("n")).cast("long").alias("n"), F.when(end, F.col("last")).otherwise(F.col("first")).alias("first"), "last", "total")


@register("state_fold", f"WITH {DOCS} SELECT source, arg_max(file, doc_id) AS latest, count(*) AS writes FROM docs GROUP BY source")
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-modify-write as an append-only log, the last write winning."""
    return docs(spark, sf_dir).groupBy("source").agg(F.max_by("file", "doc_id").alias("latest"), F.count("*").alias("writes"))


_params = [("30", "50"), ("0", "501"), ("366", "0"), ("abc", "x"), ("365", "500"), (None, None), ("1", "1")]


@register("param_clamps", f"WITH {sql_values('t', 'd string, l string', _params)} SELECT d, l, CASE WHEN try_cast(d AS INTEGER) BETWEEN 1 AND 365 THEN try_cast(d AS INTEGER) ELSE 90 END AS since_days, CASE WHEN try_cast(l AS INTEGER) BETWEEN 1 AND 500 THEN try_cast(l AS INTEGER) ELSE 100 END AS lim, greatest(1, least(10, CASE WHEN try_cast(d AS INTEGER) BETWEEN 1 AND 10 THEN try_cast(d AS INTEGER) ELSE 5 END)) AS top_k FROM t")
def param_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.col(c).try_cast("int")
    between = lambda c, lo, hi, d: F.when(n(c).between(lo, hi), n(c)).otherwise(d)
    return literals(spark, "d string, l string", _params).select("d", "l", between("d", 1, 365, 90).alias("since_days"), between("l", 1, 500, 100).alias("lim"), F.greatest(F.lit(1), F.least(F.lit(10), between("d", 1, 10, 5))).alias("top_k"))


_names = [("abc-1_2", "abc-1_2", "abc-1_2", "abc-1_2"), ("a b/c", "abc", "a_b_c", "a_b_c"), ("é!x.y", "xy", "__x_y", "é_x.y"), ("漢字", "", "__", "漢字"), ("x" * 70, "x" * 70, "x" * 63, "x" * 70)]
_N = "name string, session string, collection string, segment string"


@register("sanitize_ids", f"WITH {sql_values('t', _N, _names)} SELECT name, session, collection, segment FROM t")
def sanitize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("name")
    return literals(spark, _N, _names).select("name", ids.clean_session(c).alias("session"), ids.clean_collection(c).alias("collection"), ids.clean_segment(c).alias("segment"))
