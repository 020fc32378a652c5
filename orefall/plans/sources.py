"""Queries of sources and sinks: rows are written among the shared folders and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefall.operators import retrieval as R
from orefall.operators.repo import paper_links
from orefall.plans.evaluation import BAD, OFFLINE, ONLINE, QA, SCORED, bad, gated, online_gate
from orefall.plans.registry import register
from orefall.plans.retrieval import CORPUS, RANKED, measured
from orefall.plans.state import TRACE
from orefall.plans.views import DOCS, docs, events, literals, qa, read, sql_values
from orefall.sources import files as S


@register("jsonl_tolerant_read", f"WITH {QA} SELECT conv_id, turn, query FROM qa")
def jsonl_tolerant_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines with broken and blank ones between them."""
    path = S.scratch(spark, "jsonl")
    good = qa(spark, sf_dir).select(F.to_json(F.struct("conv_id", "turn", "query")).alias("value"))
    broken = literals(spark, "value string", [("{broken",), ("",), ("[1, 2",)])
    good.unionByName(broken).write.text(path)
    return S.read_jsonl(spark, path, "conv_id long, turn long, query string")


@register("jsonl_append_roundtrip", f"WITH {QA} SELECT conv_id, turn, repo_url FROM qa")
def jsonl_append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = S.scratch(spark, "append"), qa(spark, sf_dir).select("conv_id", "turn", "repo_url")
    S.append_jsonl(rows.where("turn % 2 = 0"), path)
    S.append_jsonl(rows.where("turn % 2 <> 0"), path)
    return S.read_jsonl(spark, path, "conv_id long, turn long, repo_url string")


@register("audit_delta", f"WITH {QA} SELECT count(*) FILTER (turn % 2 = 0) AS before, count(*) AS after, count(*) FILTER (turn % 2 <> 0) AS delta FROM qa")
def audit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts of a sink before and after an append."""
    path, rows = S.scratch(spark, "audit"), qa(spark, sf_dir).select("conv_id", "turn")
    S.append_jsonl(rows.where("turn % 2 = 0"), path)
    before = spark.read.text(path).count()
    S.append_jsonl(rows.where("turn % 2 <> 0"), path)
    after = spark.read.text(path).agg(F.count("*").alias("after"))
    return after.select(F.lit(before).cast("long").alias("before"), "after", (F.col("after") - before).alias("delta"))


@register("skipped_audit", f"WITH {QA} SELECT conv_id, turn, {ONLINE} AS reason, left(query, 200) AS query, repo_url, CAST(length(context) AS BIGINT) AS context_length, CAST(length(answer) AS BIGINT) AS answer_length FROM qa WHERE {ONLINE} IS NOT NULL")
def skipped_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, q = S.scratch(spark, "skipped"), qa(spark, sf_dir)
    rows = online_gate(spark, sf_dir).where("reason IS NOT NULL").join(q, ["conv_id", "turn"])
    rows = rows.select("conv_id", "turn", "reason", F.substring("query", 1, 200).alias("query"), "repo_url", F.length("context").alias("context_length"), F.length("answer").alias("answer_length"))
    S.append_jsonl(rows, path)
    return S.read_jsonl(spark, path, "conv_id long, turn long, reason string, query string, repo_url string, context_length long, answer_length long")


@register("clean_split", f"WITH {SCORED} SELECT CASE WHEN reason = 'passed' THEN 'passed' ELSE 'rejected' END AS sink, count(*) AS n FROM (SELECT {OFFLINE} AS reason FROM scored) GROUP BY 1")
def clean_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "clean")
    S.split_sinks(gated(spark, sf_dir).select("conv_id", "turn", "reason"), "reason", path)
    return spark.read.schema("conv_id long, turn long, reason string, sink string").json(path).groupBy("sink").agg(F.count("*").alias("n"))


@register("bad_cases_csv", f"WITH {BAD} SELECT conv_id, turn, score, array_to_string(CASE WHEN len(reasons) = 0 THEN ['unknown'] ELSE reasons END, '|') AS reasons FROM bad")
def bad_cases_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "bad-cases")
    S.write_csv(bad(spark, sf_dir).select("conv_id", "turn", "score", F.array_join("reasons", "|").alias("reasons")), path)
    return spark.read.schema("conv_id long, turn long, score double, reasons string").option("header", True).csv(path)


@register("report_rows", f"WITH {BAD} SELECT 1 AS part, 'bad cases' AS title, CAST(count(*) AS VARCHAR) AS value FROM bad UNION ALL SELECT 2, 'rows', CAST(count(*) AS VARCHAR) FROM scored UNION ALL SELECT 3, 'ready', CAST(count(*) FILTER (sft_ready) AS VARCHAR) FROM scored")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the Markdown report."""
    from orefall.plans.evaluation import judged

    j = judged(spark, sf_dir).agg(F.count_if(F.col("score") < 0.6).alias("a"), F.count("*").alias("b"), F.count_if("sft_ready").alias("c"))
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(t).alias("title"), F.col(c).cast("string").alias("value")) for i, t, c in ((1, "bad cases", "a"), (2, "rows", "b"), (3, "ready", "c"))])
    return j.select(F.inline(parts))


def markdown_report(rows: DataFrame) -> str:
    """The report text from the few rows of ``report_rows``."""
    return "\n".join(["# Evaluation report", "", *[f"- {r['title']}: {r['value']}" for r in rows.orderBy("part").collect()]])


@register("retrieval_report", f"WITH {RANKED} SELECT qid, hit, recall, precision, mrr FROM rows_ WHERE n_expected > 0")
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "report")
    S.append_jsonl(measured(spark, sf_dir).where("n_expected > 0").select("qid", "hit", "recall", "precision", "mrr"), path)
    return S.read_jsonl(spark, path, "qid long, hit int, recall double, precision double, mrr double")


_golden = [(0, '{"id": "sample_0000", "query": "a", "expected_files": ["x.py"]}', "sample_0000", "x.py"), (1, '{"query": "b", "answer_file": "y.py"}', "1", "y.py"), (2, '{"query": "c"}', "2", "")]
_G = "pos int, line string, id string, files string"


@register("golden_load", f"WITH {sql_values('t', _G, _golden)} SELECT pos, id, files FROM t")
def golden_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of old get their ordinal as id and their single answer file as expected files."""
    got = literals(spark, _G, _golden).select("pos", F.from_json("line", "id string, query string, expected_files array<string>, answer_file string").alias("g"))
    files = F.coalesce("g.expected_files", F.when(F.col("g.answer_file").isNotNull(), F.array("g.answer_file")), F.array().cast("array<string>"))
    return got.select("pos", F.coalesce("g.id", F.col("pos").cast("string")).alias("id"), F.array_join(files, ",").alias("files"))


# Index: chunks are documents, an embedding is the vector of the same number; a second write replaces some rows.
INDEX = "idx AS (SELECT d.doc_id, d.source || '/' || d.doc_id AS file, e.label AS label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE len(e.embedding) = 64)"


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.usable_vectors(read(spark, sf_dir, "embeddings"), 64)
    d = docs(spark, sf_dir)
    return d.join(e, d["doc_id"] == e["vec_id"]).select("doc_id", "file", "label")


@register("index_write", f"WITH {INDEX} SELECT doc_id, file, CASE WHEN doc_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM idx")
def index_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexed(spark, sf_dir)
    return S.upsert(rows, rows.where("doc_id % 3 = 0").withColumn("label", F.col("label") + 100), "doc_id")


@register("index_scan", f"WITH {INDEX} SELECT label, count(*) AS n, min(doc_id) AS first_id FROM idx GROUP BY label")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "index")
    indexed(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@register("index_ids", f"WITH {INDEX} SELECT doc_id, 'file_' || (row_number() OVER (ORDER BY doc_id) - 1) AS point FROM idx")
def index_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running ids over all embedded chunks, without gathering them in one task."""
    from orefall.operators.state import ordinals

    return ordinals(indexed(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", F.concat(F.lit("file_"), F.col("ordinal").cast("string")).alias("point"))


@register("session_drop", f"WITH {DOCS} SELECT source, count(*) AS n FROM docs WHERE source <> 'src3' GROUP BY source")
def session_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = S.drop_partition(spark, docs(spark, sf_dir).select("doc_id", "source"), "source", "src3", S.scratch(spark, "sessions"))
    return left.groupBy("source").agg(F.count("*").alias("n"))


@register("cache_rebuild", f"WITH {CORPUS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def cache_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written once and read back give the term counts."""
    path = S.scratch(spark, "postings-v2")
    R.postings(docs(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


# Two sources: the mirror knows the pages of encrypted hosts, the other knows all.
_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


def mirrored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("repo"))
    return p.where("url LIKE 'https:%'").drop("url"), p.drop("url")


@register("source_fallback", f"WITH p AS (SELECT page_id, url, {_HOST} AS repo FROM pages), m AS (SELECT * FROM p WHERE url LIKE 'https:%') SELECT page_id, repo FROM m UNION ALL SELECT page_id, repo FROM p WHERE repo NOT IN (SELECT repo FROM m)")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.whole_source(*mirrored(spark, sf_dir), "repo").select("page_id", "repo")


@register("content_fallback", "SELECT page_id, CASE WHEN url LIKE 'https:%' AND url NOT LIKE '%?%' THEN 'mirror ' ELSE 'api ' END || length(html) AS content FROM pages")
def content_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirror has the pages of encrypted hosts, of which those with a query are null and fall through too."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("string").alias("n"))
    mirror = p.where("url LIKE 'https:%'").select("page_id", F.when(~F.contains("url", F.lit("?")), F.concat(F.lit("mirror "), "n")).alias("content"))
    return S.content_of(mirror, p.select("page_id", F.concat(F.lit("api "), "n").alias("content")), "page_id")


_raw = [(1, "aGVsbG8=", "hello"), (2, "//79", None), (3, None, None), (4, "not base64!", None), (5, "w6k=", "é")]


@register("undecodable", f"WITH {sql_values('t', 'id int, raw string, content string', _raw)} SELECT id, content FROM t")
def undecodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.decoded(literals(spark, "id int, raw string, expected string", _raw), "id", "raw")


_tree = [(1, "docs/README.md", "x"), (1, "readme.rst", "[P](https://arxiv.org/abs/1.2)"), (2, "src/a.py", ""), (2, "README.md", "http://a.b/c.pdf"), (3, "LICENSE", "")]


@register("readme_source", "SELECT 1 AS repo, 'https://arxiv.org/pdf/1.2.pdf' AS url, 'readme.rst' AS path UNION ALL SELECT 2, 'http://a.b/c.pdf', 'README.md'")
def readme_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first readme at the root gives the paper links."""
    f = literals(spark, "repo int, path string, content string", _tree).where("lower(path) RLIKE '^readme(\\\\.[a-z]+)?$'")
    top = f.groupBy("repo").agg(F.min_by("path", F.lower("path")).alias("path"), F.min_by("content", F.lower("path")).alias("content"))
    return paper_links(top, "repo", "content").join(top.select("repo", "path"), "repo").select("repo", "url", "path")


@register("trace_log_write", f"WITH {TRACE} SELECT step AS log_type, strftime(ts, '%Y%m%d') AS day, count(*) AS n FROM trace GROUP BY 1, 2")
def trace_log_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace log by type and day, written and read with partition pruning."""
    path = S.scratch(spark, "trace-log")
    e = events(spark, sf_dir).select("event_id", "session", F.col("step").alias("log_type"), F.date_format("ts", "yyyyMMdd").alias("day"))
    e.repartition("log_type").write.partitionBy("log_type", "day").json(path)
    return spark.read.schema("event_id long, session long, log_type string, day string").json(path).groupBy("log_type", "day").agg(F.count("*").alias("n"))


@register("semi_anti_paths", "SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.page_id)")
def semi_anti_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked files that exist and were not visited."""
    p = read(spark, sf_dir, "pages").select("page_id")
    asked = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"))
    visited = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")).distinct()
    return p.join(asked, "page_id", "left_semi").join(visited, "page_id", "left_anti")
