"""Repository-side operators: file filters, issues and commits, reproducibility, claims and evidence, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefall import config
from orefall.functions import text as X
from orefall.functions.scores import r6


def keeps_file(path: Column, kind: Column, size: Column) -> Column:
    """Blobs outside ignored directories (any segment, the name included), with no ignored extension, up to the size limit."""
    parts = F.split(path, "/")
    return (kind == "blob") & ~F.arrays_overlap(parts, X.array_literal(config.IGNORED_DIRECTORIES)) & ~X.extension(path).isin(*config.IGNORED_EXTENSIONS) & (size <= config.MAX_FILE_SIZE)


def is_priority(path: Column) -> Column:
    """A source suffix, and at most two slashes or a key word in the path."""
    source = X.any_of(*[path.endswith(e) for e in config.PRIORITY_EXTENSIONS])
    return source & ((F.size(F.split(path, "/")) - 1 <= 2) | X.any_of(*[F.lower(path).contains(k) for k in config.PRIORITY_KEYWORDS]))


def parse_tree_line(line: Column) -> Column:
    """struct(path, type, size, sha) of a line ``mode type sha size<TAB>path``, or null; a size that is no number is 0."""
    halves = F.split(line, "\t", 2)
    meta = F.split(F.trim(halves[0]), "\\s+")
    size = F.coalesce(F.get(meta, F.lit(3)).try_cast("long"), F.lit(0))
    return F.when((F.size(halves) == 2) & (F.size(meta) >= 4), F.struct(F.get(halves, F.lit(1)).alias("path"), meta[1].alias("type"), size.alias("size"), meta[2].alias("sha")))


def issue_risk(title: Column, body: Column, labels: Column) -> Column:
    """struct(risk_type, severity) of an issue that points to a risk, or null."""
    low = F.transform(labels, lambda x: F.lower(x))
    text = F.concat(F.substring(F.coalesce(title, F.lit("")), 1, 500), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, 2000), F.lit("\n"), F.array_join(low, " "))
    hit = text.rlike("(?i)" + config.REPRO_PATTERN)
    named = lambda *names: X.any_of(*[F.array_contains(low, n) for n in names])
    env = hit | named("reproducibility")
    severe = F.when(env, text.rlike("(?i)" + config.SEVERE_PATTERN)).otherwise(named("critical", "blocker"))
    row = F.struct(F.when(env, "repro_env").otherwise("stability").alias("risk_type"), F.when(severe, "high").otherwise("medium").alias("severity"))
    return F.when(hit | named("bug", "reproducibility", "dependencies", "installation"), row)


def first_line(message: Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(message, "^\\s+|\\s+$", ""), "\n", 1))


def is_feature(message: Column) -> Column:
    return F.coalesce(first_line(message).rlike("(?i)" + config.FEATURE_PATTERN), F.lit(False))


def utc_iso(text: Column) -> Column:
    """ISO time in UTC with Z; text that is no time gets a Z unless it has one; empty for null and empty."""
    zoned = F.regexp_replace(text, "Z$", "+00:00")
    parsed = F.coalesce(F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd")))
    return F.when(X.blank(text), "").when(parsed.isNotNull(), F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(text.endswith("Z"), text).otherwise(F.concat(text, F.lit("Z")))


def rule_score(tree: Column, dimension: str) -> Column:
    """Sum of the weights of the signals that occur in the file tree, at most 1."""
    total = F.lit(0.0)
    for pattern, weight in config.SIGNALS[dimension]:
        total = total + F.when(tree.rlike("(?im)" + pattern), weight).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def insight_penalty(community: Column, env: Column, n_risks: Column, n_high: Column, n_scanned: Column) -> tuple[Column, Column]:
    """Community and environment scores less what risks take away: bounded by 0.38 and 0.28, not below 0."""
    share = n_risks / F.greatest(n_scanned, F.lit(1))
    c = F.greatest(F.lit(0.0), community - F.least(F.lit(0.38), 0.045 * n_risks + 0.22 * share))
    e = F.greatest(F.lit(0.0), env - F.least(F.lit(0.28), 0.07 * n_high + 0.025 * n_risks))
    return F.when(n_risks > 0, c).otherwise(community), F.when(n_risks > 0, e).otherwise(env)


# Pairs of word groups of claim and path, and what they add.
_EQUIVALENT = (
    (("regex", "正则", "pattern"), ("regex", "parser", "chunk", "token", "lex"), 2.0),
    (("split", "chunk", "tokenize", "切分", "分块", "分词"), ("chunk", "split", "token", "parser", "segment"), 1.8),
    (("retrieval", "召回", "search", "检索"), ("retriev", "search", "vector", "bm25"), 1.5),
)


def semantic_bonus(claim: Column, path: Column) -> Column:
    c, p, total = F.lower(claim), F.lower(path), F.lit(0.0)
    for claim_words, path_words, bonus in _EQUIVALENT:
        total = total + F.when(X.any_of(*[c.contains(w) for w in claim_words]) & X.any_of(*[p.contains(w) for w in path_words]), bonus).otherwise(0.0)
    return total


def jit_candidates(claims: DataFrame, paths: DataFrame, excluded: DataFrame, limit: int = 3) -> DataFrame:
    """(qid, path, score, rank): paths that claim tokens occur in, best first, then shorter, then as listed.

    ``paths`` (session, path, pos) meets ``claims`` (qid, session, text) within a session.
    """
    left = paths.join(excluded.select("session", "path"), ["session", "path"], "left_anti")
    scored = claims.join(left, "session").withColumn("score", F.size(F.filter(X.claim_tokens(F.col("text")), lambda t: F.contains(F.lower(F.col("path")), t))) + semantic_bonus(F.col("text"), F.col("path")))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.length("path"), "pos")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "path", r6("score").alias("score"), "rank")


def paper_links(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, url, title, source, rank): arXiv PDFs, arXiv abstracts as PDFs, OpenReview PDFs, other PDFs; the first of each URL."""
    t = F.col(text)
    found = lambda pattern: F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
    with_pdf = lambda u: F.when(u.endswith(".pdf"), u).otherwise(F.concat(u, F.lit(".pdf")))
    row = lambda order, source, fallback: lambda u: F.struct(F.lit(order).alias("rule"), u.alias("url"), F.lit(source).alias("source"), F.lit(fallback).alias("fallback"))
    host = lambda u: F.regexp_extract(u, "://([^/?#]*)", 1)
    lists = F.concat(
        F.transform(F.transform(found(config.ARXIV_PDF), with_pdf), row(1, "arxiv", "arXiv PDF")),
        F.transform(F.transform(found(config.ARXIV_ABS), lambda u: with_pdf(F.replace(u, F.lit("/abs/"), F.lit("/pdf/")))), row(2, "arxiv", "arXiv PDF")),
        F.transform(F.transform(found(config.OPENREVIEW), lambda u: F.replace(u, F.lit("forum?"), F.lit("pdf?"))), row(3, "openreview", "OpenReview PDF")),
        F.transform(F.filter(found(config.GENERIC_PDF), lambda u: ~host(u).contains("arxiv.org") & ~host(u).contains("openreview.net")), row(4, "pdf", "Paper PDF")),
    )
    rows = pages.select(key, text, F.posexplode(lists).alias("pos", "x")).select(key, "pos", "x.*", F.rtrim(F.col("x.url"), F.lit("/")).alias("canon"))
    titles = pages.select(key, F.posexplode(F.regexp_extract_all(t, F.lit("(\\[[^\\]]*\\]\\(https?://[^\\s)]+\\))"), F.lit(1))).alias("at", "link"))
    titles = titles.select(key, "at", F.regexp_extract("link", "^\\[([^\\]]*)\\]", 1).alias("title"), F.regexp_extract("link", "\\((.*)\\)$", 1).alias("url"))
    titles = titles.groupBy(key, "url").agg(F.max_by("title", "at").alias("title"))
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "canon").orderBy("pos"))).where("n = 1")
    named = once.join(titles, [key, "url"], "left").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    return named.select(key, F.col("canon").alias("url"), F.trim(F.coalesce(F.when(F.col("title") != "", F.col("title")), "fallback")).alias("title"), "source", "rank")


def evidence_spans(hits: DataFrame, k: int) -> DataFrame:
    """(qid, rank, file, start_line, end_line, snippet, score) of the k best hits with text."""
    end = F.when(F.col("start_line").isNotNull() & F.col("end_line").isNull(), F.greatest(F.col("start_line"), F.col("start_line") + X.newlines(F.col("content")))).otherwise(F.col("end_line"))
    return hits.where((F.col("rank") <= k) & (F.trim("content") != "")).select("qid", "rank", "file", "start_line", end.alias("end_line"), F.substring("content", 1, 500).alias("snippet"), r6("score").alias("score"))


def align_confidence(items: DataFrame) -> DataFrame:
    """(paper, n_claims, confidence): aligned claims count 1, other kept ones a half; rounded to four digits."""
    value = F.when(F.col("status") == "aligned", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    return items.groupBy("paper").agg(F.count("*").alias("n_claims"), F.round(F.sum(value) / F.count("*") + 1e-9, 4).alias("confidence"))
