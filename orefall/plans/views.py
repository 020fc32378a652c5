"""Derived views that the registered queries share, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefall.functions.scores import content_words, lowered
from orefall.operators.evaluation import found_earlier


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with file = source/doc_id."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), "source", "lang", "text")


DOCS = "docs AS (SELECT doc_id, source || '/' || doc_id AS file, source, lang, text FROM documents)"


def qa(spark: SparkSession, sf_dir: str, found: bool = False) -> DataFrame:
    """Each user turn with the assistant turn after it; context is what was said before, in order.

    With ``found``, also how many content words the answer has, and how many of them the context has.
    """
    c = read(spark, sf_dir, "conversations")
    more = []
    if found:
        c = c.select("conv_id", "turn", "role", "text", lowered(F.col("text")).alias("low"), F.when(F.col("role") == "assistant", content_words(F.col("text"))).alias("wanted"))
        c = found_earlier(c.withColumn("content", F.size("wanted")), "conv_id", "turn", "low", "wanted", gap=2)
        more = [F.lead(x).over(Window.partitionBy("conv_id").orderBy("turn")).alias(x) for x in ("content", "found")]
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("next_turn"), F.lead("text").over(w).alias("answer"), F.array_join(F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, -1)), "\n").alias("context"), *more)
    pairs = said.where("role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1")
    return pairs.select("conv_id", "turn", F.col("text").alias("query"), "answer", F.coalesce("context", F.lit("")).alias("context"), F.when(F.col("conv_id") % 7 != 3, F.concat(F.lit("https://github.com/org"), F.col("conv_id") % 5, F.lit("/repo"), "conv_id")).otherwise("").alias("repo_url"), *(("content", "found") if found else ()))


QA = """qa AS (
  SELECT conv_id, turn, text AS query, answer, coalesce(context, '') AS context,
         CASE WHEN conv_id % 7 <> 3 THEN 'https://github.com/org' || (conv_id % 5) || '/repo' || conv_id ELSE '' END AS repo_url
  FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn, lead(text) OVER w AS answer,
               string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows: session = user_id, step = event_type, latency = value, k from props."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.col("event_type").alias("step"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("int").alias("k"), "props")


TRACE = "trace AS (SELECT event_id, ts, user_id AS session, event_type AS step, value AS latency, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props FROM events)"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue-like rows from orders: number, state, label, updated, title, body, and whether it is a pull request."""
    o = read(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    title = F.concat(F.element_at(F.array(*map(F.lit, ISSUE_TITLES)), (n % len(ISSUE_TITLES) + 1).cast("int")), F.lit(" #"), n)
    return o.select(
        n.alias("number"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
        F.when(n % 4 == 0, "bug").when(n % 9 == 0, "critical").otherwise(F.lower(F.element_at(F.split("o_orderpriority", "-"), 2))).alias("label"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"), title.alias("title"), F.concat(F.lit("seen by customer "), "o_custkey").alias("body"), (n % 5 == 0).alias("is_pull"),
    )


ISSUE_TITLES = ("Cannot reproduce the result", "Docker build fails", "Typo in the guide", "pip install fails", "Add a feature", "Dependency conflict", "Crash on start", "Version  mismatch in the wheel")
_titles = ", ".join(f"'{t}'" for t in ISSUE_TITLES)
ISS = f"""iss AS (
  SELECT o_orderkey AS number, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
         CASE WHEN o_orderkey % 4 = 0 THEN 'bug' WHEN o_orderkey % 9 = 0 THEN 'critical' ELSE lower(string_split(o_orderpriority, '-')[2]) END AS label,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated,
         ([{_titles}])[CAST(o_orderkey % {len(ISSUE_TITLES)} AS INTEGER) + 1] || ' #' || o_orderkey AS title, 'seen by customer ' || o_custkey AS body, o_orderkey % 5 = 0 AS is_pull
  FROM orders)"""


def literals(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def sql_text(value) -> str:
    """A value as a DuckDB literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(sql_text, value)) + "]"
    parts = []
    for i, line in enumerate(str(value).split("\n")):
        if i:
            parts.append("chr(10)")
        parts.append("'" + line.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE with literal rows; ``columns`` as for ``literals``."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    fields = [c.split() for c in columns.split(", ")]
    body = " UNION ALL ".join("SELECT " + ", ".join(f"CAST({sql_text(v)} AS {kinds[k]}) AS {c}" for v, (c, k) in zip(r, fields, strict=True)) for r in rows)
    return f"{name} AS ({body})"
