"""Queries of reply parsing, text clean-up, prompts and small set operations; literals carry hand-computed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefall.functions import replies as P
from orefall.functions import text as X
from orefall.functions.scores import r6
from orefall.operators import repo as R
from orefall.plans.registry import register
from orefall.plans.views import DOCS, ISS, QA, docs, events, issues, literals, qa, read, sql_text, sql_values


def expected(name: str, columns: str, rows: list[tuple], out: str):
    """A query over literal rows whose oracle is the hand-computed column ``expected``."""

    def add(f):
        key = columns.split(", ")[0].split()[0]

        @register(name, f"WITH {sql_values('t', columns, rows)} SELECT {key}, expected AS {out} FROM t")
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return literals(spark, columns, rows).select(key, f(F.col(key)).alias(out))

        return query

    return add


T = "```"
expected("json_fences", "raw string, expected string", [(f"{T}json\n{{\"a\": 1}}\n{T}", '{"a": 1}'), (f"{T}\n[1]\n{T}", "[1]"), ("  plain ", "plain"), ("", ""), (f"x {T}", "x"), (None, None)], "text")(X.strip_fences)
expected("json_list_extract", "raw string, expected string", [('["a", "b"]', "a|b"), (f'{T}json\n["c"]\n{T}', "c"), ('Sure: ["d","e"] done', "d|e"), ("none", ""), ("[broken", "")], "items")(lambda c: F.array_join(X.json_list(c), "|"))
expected("tool_tags", "raw string, expected string", [("<tool_code>'a.py'</tool_code> and <tool_code>\n`b.py` </tool_code>", "a.py|b.py"), ("none", ""), ("<tool_code></tool_code>", "")], "paths")(lambda c: F.array_join(F.filter(F.transform(X.tool_paths(c), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != ""), "|"))
expected("code_blocks", "raw string, expected string", [(f"a\n{T}python\nx = 1\ny = 2\n{T}\nb {T}\nz\n{T}", "x = 1\ny = 2|z"), ("no block", ""), (f"{T}open", "")], "blocks")(lambda c: F.array_join(X.code_blocks(c), "|"))
expected("path_extract", "raw string, expected string", [("├── src/a.py", "src/a.py"), ("app.tsx and x.jsx, data.json", "app.ts|x.js|data.js"), ("main.cs b.cpp", "main.c|b.cpp"), ("nothing", "")], "paths")(lambda c: F.array_join(X.code_paths(c), "|"))
expected("query_normalize", "raw string, expected string", [("  Two   Words\n", "two words"), ("A\tB", "a b"), ("é x", "é x"), ("", "")], "norm")(X.normalize_query)
expected("error_reason", "raw string, expected string", [("  a\nb\r ", "a b"), ("", "unknown"), (None, "unknown"), ("x" * 130, "x" * 120)], "reason")(lambda c: F.trim(X.error_reason(c)))
expected("safe_cast", "raw string, expected int", [("12", 12), ("x", None), (" 7 ", 7), ("", None), (None, None), ("3.5", None)], "value")(lambda c: c.try_cast("int"))
expected("iso_dates", "raw string, expected string", [("2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z"), ("2024-01-02T03:04:05+02:00", "2024-01-02T01:04:05Z"), ("2024-01-02T03:04:05", "2024-01-02T03:04:05Z"), ("soon", "soonZ"), ("badZ", "badZ"), ("", ""), (None, "")], "iso")(R.utc_iso)
expected("message_class", "raw string, expected string", [("HTTP 401", "auth"), ("API rate limit", "rate_limit"), ("404 Not Found", "not_found"), ("read timed out", "timeout"), ("boom", "other")], "kind")(P.message_class)
expected("judge_score_parse", "raw string, expected double", [("0.85", 0.85), ("Score: 7", 1.0), ("none", 0.5), ("0", 0.0), (".5 of 1", 1.0)], "score")(P.score_number)
expected("status_ui", "raw string, expected string", [("insufficient_evidence", "missing"), ("aligned", "aligned"), ("missing", "missing"), ("partial", "partial")], "status")(P.ui_status)
expected("claims_parse", "raw string, expected string", [('{"claims": [" a ", "", "b"]}', "a|b"), (f'{T}json\n{{"claims": ["c"]}}\n{T}', "c"), ("bad", ""), ('{"other": 1}', "")], "claims")(lambda c: F.array_join(P.claims(c), "|"))
expected("risks_parse", "raw string, expected string", [('{"summary": "s", "risks": [{"title": "t1"}, {"title": "t2"}]}', "s:t1,t2"), ("", "rule-based score only:"), (None, "rule-based score only:"), ('{"summary": "only"}', "only:")], "parsed")(lambda c: F.concat(P.risks(c)["summary"], F.lit(":"), F.array_join(P.risks(c)["titles"], ",")))
expected("questions_normalize", "raw string, expected string", [('{"macro": "A?", "implementation": "B?", "reproduction": "a?"}', "A?|B?|d3"), ('{"questions": ["x", "y", "z"]}', "x|y|z"), ('{"questions": ["x", "y"]}', "d1|d2|d3"), ("bad", "d1|d2|d3"), ('{"macro": " "}', "d1|d2|d3")], "three")(lambda c: F.array_join(P.questions(c, ("d1", "d2", "d3")), "|"))
expected("route_distinct", "raw string, expected string", [('{"queries": {"keyword_compact": "Claim", "implementation_view": "how", "synonym_expansion": "HOW"}}', "claim:1.0|how:0.78"), ('{"queries": {"keyword_compact": "kw"}}', "claim:1.0|kw:0.82"), ("bad", "claim:1.0")], "routes")(lambda c: F.array_join(F.transform(P.routes(c, F.lit(" claim ")), lambda p: F.concat_ws(":", p["text"], p["weight"].cast("string"))), "|"))
expected("query_rewrite_join", "raw string, expected string", [('["a", "b"]', "a b"), ("bad", "bad"), ("[]", "[]")], "query")(lambda c: F.coalesce(F.when(F.size(X.json_list(c)) > 0, F.array_join(X.json_list(c), " ")), c))
expected("ndjson_lines", "raw string, expected string", [('{"type": "a"}\n\nbad\n{"type": "b"}', "a|b"), ("", ""), ("\n\n", "")], "types")(lambda c: F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.get_json_object(x, "$.type")), lambda x: x.isNotNull()), "|"))
expected("text_cleanup", "raw string, expected string", [("a  \nb\n\n\n\nc ", "a\nb\n\nc"), ("  x", "x"), ("", "")], "text")(lambda c: X.page_text(F.array(c)))

_judge = [("j1", '{"status": "aligned", "matched_files": ["a.py"], "evidence_excerpt": "x"}', "aligned:a.py:x"), ("j2", '{"status": "odd"}', "missing:h1,h2,h3,h4,h5:"), ("j3", "broken", "insufficient_evidence:h1,h2,h3,h4,h5:"), ("j4", f'{T}json\n{{"status": "partial", "matched_files": []}}\n{T}', "partial:h1,h2,h3,h4,h5:")]


@register("judge_parse", f"WITH {sql_values('t', 'id string, raw string, expected string', _judge)} SELECT id, expected AS parsed FROM t")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array(*[F.lit(f"h{i}") for i in range(1, 8)])
    j = literals(spark, "id string, raw string, expected string", _judge).select("id", P.judged(F.col("raw"), hits).alias("j"))
    return j.select("id", F.concat_ws(":", "j.status", F.array_join("j.files", ","), "j.excerpt").alias("parsed"))


_local = [("l1", '{"summary": "s", "risks": ["r1", "r2"]}', "s|r1,r2"), ("l2", '{"summary": 5}', "5|"), ("l3", "bad", "|"), ("l4", '{"risks": "no list"}', "|")]


@register("localized_parse", f"WITH {sql_values('t', 'id string, raw string, expected string', _local)} SELECT id, expected AS parsed FROM t")
def localized_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    listed = F.from_json(F.get_json_object(raw, "$.risks"), "array<string>")
    text = F.concat_ws("|", F.coalesce(F.get_json_object(raw, "$.summary"), F.lit("")), F.coalesce(F.array_join(listed, ","), F.lit("")))
    return literals(spark, "id string, raw string, expected string", _local).select("id", text.alias("parsed"))


_cached = [(1, '{"overall_score_raw": 0.82}', '{"summary": "ok"}', 0.82, "ok", True), (2, '{"overall_score_raw": "x"}', '{"summary": "ok"}', 0.0, "ok", True), (3, "{}", None, 0.0, "", False)]
_CC = "id int, core string, localized string, raw double, summary string, hit boolean"


@register("cached_result", f"WITH {sql_values('t', _CC, _cached)} SELECT id, raw, summary, hit FROM t")
def cached_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.get_json_object("core", "$.overall_score_raw").try_cast("double"), F.lit(0.0))
    return literals(spark, _CC, _cached).select("id", raw.alias("raw"), F.coalesce(F.get_json_object("localized", "$.summary"), F.lit("")).alias("summary"), F.col("localized").isNotNull().alias("hit"))


_ragas = [(1, 0.8, 0.6, 0.7), (2, None, 0.6, 0.6), (3, 0.4, None, 0.4), (4, None, None, None)]


@register("ragas_mean", f"WITH {sql_values('t', 'id int, a double, b double, expected double', _ragas)} SELECT id, expected AS mean FROM t")
def ragas_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, "id int, a double, b double, expected double", _ragas).select("id", r6(P.paired_mean(F.col("a"), F.col("b"))).alias("mean"))


_jit = [(1, 2, 1, 5, "loaded 2, failed 1, remaining 2"), (2, 0, 0, 0, "nothing to load"), (3, 3, 0, 3, "loaded 3, failed 0, remaining 0")]


@register("jit_status", f"WITH {sql_values('t', 'id int, a int, b int, c int, expected string', _jit)} SELECT id, expected AS message FROM t")
def jit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, "id int, a int, b int, c int, expected string", _jit).select("id", P.jit_status(F.col("a"), F.col("b"), F.col("c")).alias("message"))


@register("embed_preprocess", "SELECT doc_id, left(trim(replace(text, chr(10), ' ')), 8000) AS text FROM documents")
def embed_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.embed_text(F.col("text")).alias("text"))


@register("text_rechunk", "SELECT doc_id, i AS chunk, substr(text, CAST(i * 900 + 1 AS BIGINT), 900) AS part FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 900) AS BIGINT))) AS i FROM documents)")
def text_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.rechunk(F.col("text"))).alias("chunk", "part"))
    return parts.withColumn("chunk", F.col("chunk").cast("long"))


@register("prompt_lines", f"WITH {ISS} SELECT number, '- #' || number || ' [' || state || '] ' || left(title, 100) || ' (' || label || ')' AS line, left(updated, 10) || ' ' || left(md5(title), 7) AS commit_line FROM iss")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = issues(spark, sf_dir)
    return i.select("number", F.format_string("- #%d [%s] %s (%s)", "number", "state", F.substring("title", 1, 100), "label").alias("line"), F.concat_ws(" ", F.substring("updated", 1, 10), F.substring(F.md5("title"), 1, 7)).alias("commit_line"))


@register("context_block", f"WITH {QA} SELECT conv_id, string_agg('--- File: ' || turn || ' ---' || chr(10) || left(answer, 2000), chr(10) || chr(10) ORDER BY turn) AS block FROM qa GROUP BY conv_id")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("--- File: "), F.col("turn").cast("string"), F.lit(" ---\n"), F.substring("answer", 1, 2000))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return qa(spark, sf_dir).groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("block"))


@register("rank_windows", f"WITH {DOCS} SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ordinal FROM docs")
def rank_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.length("text")), "doc_id")).cast("long").alias("rank"), (F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1).cast("long").alias("ordinal"))


_ctx = [(0, "x = 1"), (1, "#include <a>"), (2, "typedef int t;"), (3, "import b"), (4, "#define X"), (5, "using c;"), (6, "struct s {"), (7, "enum e {")]


@register("stable_priority", f"WITH {sql_values('t', 'ord int, line string', _ctx)} SELECT ord, line, row_number() OVER (ORDER BY CASE WHEN regexp_matches(line, '^(#include|import|using)') THEN 0 WHEN starts_with(line, '#define') THEN 1 WHEN regexp_matches(line, '^(typedef|enum|struct)') THEN 2 ELSE 3 END, ord) AS place FROM t")
def stable_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    priority = F.when(line.rlike("^(#include|import|using)"), 0).when(line.startswith("#define"), 1).when(line.rlike("^(typedef|enum|struct)"), 2).otherwise(3)
    return literals(spark, "ord int, line string", _ctx).select("ord", "line", F.row_number().over(Window.orderBy(priority, "ord")).cast("long").alias("place"))


@register("latest_by_name", f"WITH {DOCS} SELECT source, max(file) AS latest FROM docs GROUP BY source")
def latest_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.max("file").alias("latest"))


@register("commit_latest10", f"WITH {ISS} SELECT number, updated, row_number() OVER (ORDER BY updated, number) AS place FROM (SELECT * FROM iss ORDER BY updated DESC, number DESC LIMIT 10)")
def commit_latest10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest (a list of fixed length), oldest first."""
    ten = issues(spark, sf_dir).orderBy(F.desc("updated"), F.desc("number")).limit(10)
    return ten.select("number", "updated", F.row_number().over(Window.orderBy("updated", "number")).cast("long").alias("place"))


_refs = [("r1", ["README.md", "issue#1"], ["issue#1", "commit:abc"], "README.md|issue#1|commit:abc"), ("r2", [], ["a", "a"], "a"), ("r3", [], [], "")]


@register("evidence_refs", f"WITH t(id, expected) AS (VALUES {', '.join(f'({sql_text(r[0])}, {sql_text(r[3])})' for r in _refs)}) SELECT id, expected AS refs FROM t")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literals(spark, "id string, a array<string>, b array<string>, expected string", _refs)
    return rows.select("id", F.array_join(F.array_distinct(F.concat("a", "b")), "|").alias("refs"))


@register("risk_union", f"WITH {ISS} SELECT number, 'insight' AS origin FROM iss WHERE label = 'bug' UNION ALL SELECT number, 'model' FROM iss WHERE label = 'critical' UNION ALL SELECT number, 'model' FROM iss WHERE label = 'bug' AND number % 8 = 0")
def risk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = issues(spark, sf_dir)
    mark = lambda d, origin: d.select("number", F.lit(origin).alias("origin"))
    return mark(i.where("label = 'bug'"), "insight").unionByName(mark(i.where("label = 'critical'"), "model")).unionByName(mark(i.where("label = 'bug' AND number % 8 = 0"), "model"))


@register("set_algebra", "WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (value < 10)) AS a, list_sort(list(DISTINCT event_type) FILTER (value >= 10)) AS b FROM events GROUP BY user_id), f AS (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM e) SELECT user_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either FROM f")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy(F.col("session").alias("user_id")).agg(F.collect_set(F.when(F.col("latency") < 10, F.col("step"))).alias("a"), F.collect_set(F.when(F.col("latency") >= 10, F.col("step"))).alias("b"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return e.select("user_id", joined(F.array_intersect("a", "b")).alias("both"), joined(F.array_except("a", "b")).alias("only_a"), joined(F.array_union("a", "b")).alias("either"))


@register("report_retrieval", "SELECT item_id, snippet FROM (SELECT item_id, left(text, 400) AS snippet, row_number() OVER (PARTITION BY left(text, 400) ORDER BY item_id) AS n FROM benchmark) WHERE n = 1")
def report_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets, each once."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 400).alias("snippet"))
    return b.groupBy("snippet").agg(F.min("item_id").alias("item_id"))


@register("fence_spans", f"WITH {DOCS} SELECT doc_id, CAST(greatest(1, 1 + length(text) - length(replace(text, chr(10), ''))) AS INTEGER) AS end_line FROM docs")
def fence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """end_line = start line plus line feeds."""
    return docs(spark, sf_dir).select("doc_id", F.greatest(F.lit(1), 1 + X.newlines(F.col("text"))).alias("end_line"))
