"""Queries of the repository-side operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefall import config
from orefall.functions import ids
from orefall.functions import scores as S
from orefall.functions import text as X
from orefall.functions.scores import r6
from orefall.operators import repo as R
from orefall.plans.evaluation import _list
from orefall.plans.registry import register
from orefall.plans.retrieval import CORPUS, Q, asked, bm25_sql
from orefall.plans.views import ISS, issues, literals, read, sql_text, sql_values
from orefall.plans.views import docs as docs_view

# Files: a path of folders and an extension from each page's url, and literal edge cases.
_paths = [("src/main.py", "blob", 10), ("a/node_modules/x.js", "blob", 5), ("img/logo.PNG", "blob", 5), ("src", "tree", 0), ("big.py", "blob", 500001), ("edge.py", "blob", 500000), (".gitignore", "blob", 4), (".github/workflows/ci.yml", "blob", 4), ("dist", "blob", 1), ("a/b/c/d.ts", "blob", 9), ("a/b/c/core_d.ts", "blob", 9), ("x/.DS_Store", "blob", 1), ("Pipfile.lock", "blob", 1)]
_F = "path string, kind string, size long"
FILES = f"""{sql_values('lit', _F, _paths)},
files AS (SELECT path, kind, size FROM lit UNION ALL SELECT regexp_replace(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/+$', '') || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.png' WHEN 2 THEN '/core.ts' ELSE '' END, 'blob', CAST(length(html) AS BIGINT) FROM pages)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    tail = F.when(F.col("page_id") % 4 == 0, ".py").when(F.col("page_id") % 4 == 1, ".png").when(F.col("page_id") % 4 == 2, "/core.ts").otherwise("")
    path = F.concat(F.regexp_replace(F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1), "/+$", ""), tail)
    return literals(spark, _F, _paths).unionByName(p.select(path.alias("path"), F.lit("blob").alias("kind"), F.length("html").cast("long").alias("size")))


EXT = "lower(regexp_extract(regexp_replace(regexp_extract(path, '[^/]*$'), '^\\.+', ''), '(\\.[^.]*)$', 1))"
KEEPS = f"kind = 'blob' AND NOT list_has_any(string_split(path, '/'), {_list(config.IGNORED_DIRECTORIES)}) AND NOT list_contains({_list(config.IGNORED_EXTENSIONS)}, {EXT}) AND size <= {config.MAX_FILE_SIZE}"


@register("file_filter", f"WITH {FILES} SELECT path, kind, size, {KEEPS} AS keep FROM files")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", "kind", "size", R.keeps_file(F.col("path"), F.col("kind"), F.col("size")).alias("keep"))


PRIORITY = f"(len(list_filter({_list(config.PRIORITY_EXTENSIONS)}, lambda e: ends_with(path, e))) > 0 AND (len(string_split(path, '/')) - 1 <= 2 OR len(list_filter({_list(config.PRIORITY_KEYWORDS)}, lambda w: contains(lower(path), w))) > 0))"


@register("repo_map_targets", f"WITH {FILES}, d AS (SELECT DISTINCT path FROM files WHERE {KEEPS}), p AS (SELECT path, {PRIORITY} AS priority FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY path) AS n FROM p) SELECT path, priority, n FROM r WHERE priority AND n <= 25 UNION ALL SELECT NULL, false, count(*) FROM p WHERE NOT (priority AND path IN (SELECT path FROM r WHERE priority AND n <= 25))")
def repo_map_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 priority files in order (a report of fixed length), and how many files remain."""
    kept = files(spark, sf_dir).where(R.keeps_file(F.col("path"), F.col("kind"), F.col("size"))).select("path").distinct()
    marked = kept.withColumn("priority", R.is_priority(F.col("path")))
    top = marked.where("priority").orderBy("path").limit(25)
    top = top.withColumn("n", F.row_number().over(Window.orderBy("path")).cast("long"))
    rest = marked.join(top.select("path"), "path", "left_anti").agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("path"), F.lit(False).alias("priority"), "n")
    return top.unionByName(rest)


_tree = [("100644 blob abc123 120\tsrc/a.py",), ("040000 tree def456 -\tsrc",), ("100644 blob 789\tshort.py",), ("no tab here",), ("100644 blob aaa1 77\twith space.txt",), ("",), ("160000 commit bbb -\tsub\tmodule",)]


@register("tree_parse", f"WITH {sql_values('t', 'line string', _tree)}, s AS (SELECT line, strpos(line, chr(9)) AS tab, regexp_split_to_array(trim(left(line, greatest(strpos(line, chr(9)) - 1, 0))), '\\s+') AS m FROM t) SELECT line, substr(line, tab + 1) AS path, m[2] AS type, coalesce(try_cast(m[4] AS BIGINT), 0) AS size, m[3] AS sha FROM s WHERE tab > 0 AND len(m) >= 4".replace("(VALUES", "(VALUES").replace("\t", "' || chr(9) || '"))
def tree_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, "line string", _tree).withColumn("f", R.parse_tree_line(F.col("line"))).where("f is not null").select("line", "f.path", "f.type", "f.size", "f.sha")


@register("issue_scan", f"WITH {ISS} SELECT number, title, left(body, 500) AS body, label, updated FROM (SELECT * FROM iss WHERE state = 'open' ORDER BY updated DESC, number LIMIT 90) WHERE NOT is_pull")
def issue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of 30, the latest first (a report of fixed length), of which pull requests then go."""
    page = issues(spark, sf_dir).where("state = 'open'").orderBy(F.desc("updated"), "number").limit(90)
    return page.where("NOT is_pull").select("number", "title", F.substring("body", 1, 500).alias("body"), "label", "updated")


@register("issue_scan_since", f"WITH {ISS} SELECT number, label, updated FROM iss WHERE state = 'open' AND updated >= '1998-01-01T00:00:00Z' AND NOT is_pull")
def issue_scan_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).where("state = 'open' AND updated >= '1998-01-01T00:00:00Z' AND NOT is_pull").select("number", "label", "updated")


_rx = lambda p: "(?i)" + p
RISK = f"""risk AS (SELECT number, label, hit, env, CASE WHEN env THEN 'repro_env' ELSE 'stability' END AS risk_type,
  CASE WHEN CASE WHEN env THEN regexp_matches(t, '{_rx(config.SEVERE_PATTERN)}') ELSE label IN ('critical', 'blocker') END THEN 'high' ELSE 'medium' END AS severity FROM (
    SELECT *, hit OR label = 'reproducibility' AS env FROM (SELECT *, regexp_matches(t, {sql_text(_rx(config.REPRO_PATTERN))}) AS hit FROM (SELECT *, left(title, 500) || chr(10) || left(body, 2000) || chr(10) || label AS t FROM iss)))
  WHERE hit OR label IN ('bug', 'reproducibility', 'dependencies', 'installation'))"""


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = issues(spark, sf_dir).withColumn("risk", R.issue_risk(F.col("title"), F.col("body"), F.array("label")))
    return i.where("risk is not null").select("number", "label", "risk.risk_type", "risk.severity")


@register("issue_risk", f"WITH {ISS}, {RISK} SELECT number, label, risk_type, severity FROM risk")
def issue_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir)


_messages = [("feat: add x",), ("feature(api)!: y\n\nbody",), ("Feat! z",), ("featuring w",), ("fix: feat",), ("  feat\nmore",), ("FEATURE",), ("",), (None,), ("feats: no",)]


@register("commit_feats", f"WITH {sql_values('t', 'message string', _messages)}, f AS (SELECT message, trim(split_part(regexp_replace(message, '^\\s+|\\s+$', '', 'g'), chr(10), 1)) AS line FROM t) SELECT message, left(line, 500) AS line FROM f WHERE regexp_matches(line, {sql_text(_rx(config.FEATURE_PATTERN))})")
def commit_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = literals(spark, "message string", _messages).where(R.is_feature(F.col("message")))
    return m.select("message", F.substring(R.first_line(F.col("message")), 1, 500).alias("line"))


@register("insight_stats", f"WITH {ISS}, {RISK} SELECT (SELECT count(*) FROM iss) AS issues_total, (SELECT count(*) FROM risk) AS risk_count, (SELECT count(*) FROM risk WHERE severity = 'high') AS high_count, (SELECT count(*) FROM risk WHERE risk_type = 'repro_env' AND severity = 'high') AS high_repro")
def insight_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = issues(spark, sf_dir).withColumn("risk", R.issue_risk(F.col("title"), F.col("body"), F.array("label")))
    high = F.col("risk.severity") == "high"
    return i.agg(F.count("*").alias("issues_total"), F.count("risk").alias("risk_count"), F.count_if(high).alias("high_count"), F.count_if(high & (F.col("risk.risk_type") == "repro_env")).alias("high_repro"))


_trees = [
    ("full", "README.md\nLICENSE\nrequirements.txt\nsetup.py\nDockerfile\n.env.example\n.github/workflows/ci.yml\n.github/ISSUE_TEMPLATE/bug.md\nCONTRIBUTING.md\nCHANGELOG.md\nSECURITY.md\nsrc/main.py\ntests/test_a.py\ndocs/index.md\nexamples/run.py\nMakefile"),
    ("bare", "notes.txt\ndata.csv"), ("code", "src/index.ts\nsrc/a.test.ts\npackage.json\nyarn.lock"), ("empty", ""), ("docs", "readme\ndocumentation/a\nnotebooks/x.ipynb\nHISTORY.rst"),
]


def _dims_sql(tree: str) -> str:
    out = []
    for name, signals in config.SIGNALS.items():
        terms = " + ".join(f"CASE WHEN regexp_matches({tree}, {sql_text('(?im)' + p)}) THEN {w} ELSE 0 END" for p, w in signals)
        out.append(f"least(1.0, {terms}) AS {name}")
    return ", ".join(out)


DIMS = f"{sql_values('trees', 'name string, tree string', _trees)}, dims AS (SELECT name, {_dims_sql('tree')} FROM trees)"


def dims(spark: SparkSession) -> DataFrame:
    return literals(spark, "name string, tree string", _trees).select("name", *[R.rule_score(F.col("tree"), d).alias(d) for d in config.SIGNALS])


@register("rule_scores", f"WITH {DIMS} SELECT name, round(code_structure, 6) AS code_structure, round(docs_quality, 6) AS docs_quality, round(env_readiness, 6) AS env_readiness, round(community_stability, 6) AS community_stability FROM dims")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims(spark).select("name", *[r6(d).alias(d) for d in config.SIGNALS])


_insights = [("none", 0, 0, 10), ("four", 4, 4, 8), ("many", 30, 12, 40), ("one", 1, 0, 0)]
_I = "insight string, n_risks int, n_high int, n_scanned int"
PENALTY = f"""{DIMS}, {sql_values('ins', _I, _insights)},
pen AS (SELECT name, insight, n_risks, code_structure, docs_quality,
  CASE WHEN n_risks > 0 THEN greatest(0.0, env_readiness - least(0.28, 0.07 * n_high + 0.025 * n_risks)) ELSE env_readiness END AS env,
  CASE WHEN n_risks > 0 THEN greatest(0.0, community_stability - least(0.38, 0.045 * n_risks + 0.22 * (n_risks / greatest(n_scanned, 1)))) ELSE community_stability END AS community FROM dims CROSS JOIN ins),
overall AS (SELECT *, (code_structure + docs_quality + env + community) / 4 AS raw FROM pen)"""


def penalised(spark: SparkSession) -> DataFrame:
    d = dims(spark).crossJoin(F.broadcast(literals(spark, _I, _insights)))
    c, e = R.insight_penalty(F.col("community_stability"), F.col("env_readiness"), F.col("n_risks"), F.col("n_high"), F.col("n_scanned"))
    d = d.withColumns({"env": e, "community": c})
    return d.withColumn("raw", (F.col("code_structure") + F.col("docs_quality") + F.col("env") + F.col("community")) / 4)


@register("insight_penalty", f"WITH {PENALTY} SELECT name, insight, round(env, 6) AS env, round(community, 6) AS community, round(raw, 6) AS raw FROM overall")
def insight_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return penalised(spark).select("name", "insight", r6("env").alias("env"), r6("community").alias("community"), r6("raw").alias("raw"))


_raws = [(0.80,), (0.79,), (0.60,), (0.59,), (0.9,), (0.7,), (0.5,), (0.49,), (0.725,), (0.715,), (1.0,), (0.0,)]


@register("repro_level", f"WITH {sql_values('t', 'raw double', _raws)} SELECT raw, CASE WHEN raw >= 0.8 THEN 'high' WHEN raw >= 0.6 THEN 'medium' ELSE 'low' END AS level, CASE WHEN raw >= 0.9 THEN 'gold' WHEN raw >= 0.7 THEN 'silver' WHEN raw >= 0.5 THEN 'bronze' ELSE 'rejected' END AS tier, CAST(round_even(raw * 100, 0) AS INTEGER) AS overall FROM t")
def repro_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("raw")
    return literals(spark, "raw double", _raws).select("raw", S.level(r).alias("level"), S.tier(r).alias("tier"), F.bround(r * 100, 0).cast("int").alias("overall"))


@register("repro_risks", f"WITH {ISS}, {RISK} SELECT number, 'issue#' || number AS ref, 'GitHub ' || risk_type || ' (' || severity || '): see issue tracker' AS reason FROM risk ORDER BY number LIMIT 8")
def repro_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight risks (a list of fixed length), with where they come from and why."""
    r = risks(spark, sf_dir).orderBy("number").limit(8)
    return r.select("number", F.concat(F.lit("issue#"), "number").alias("ref"), F.format_string("GitHub %s (%s): see issue tracker", "risk_type", "severity").alias("reason"))


# Claims: the sentences of the benchmark items; status from their length.
CLAIMS = "claims AS (SELECT item_id AS paper, s AS claim, CASE length(s) % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'partial' WHEN 2 THEN 'missing' ELSE 'insufficient_evidence' END AS status FROM (SELECT item_id, unnest(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM benchmark))"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    c = b.select(F.col("item_id").alias("paper"), F.explode(F.filter(F.transform(F.split("text", "\\."), lambda x: F.trim(x)), lambda x: x != "")).alias("claim"))
    n = F.length("claim") % 4
    return c.withColumn("status", F.when(n == 0, "aligned").when(n == 1, "partial").when(n == 2, "missing").otherwise("insufficient_evidence"))


@register("align_confidence", f"WITH {CLAIMS} SELECT paper, count(*) AS n_claims, round(sum(CASE status WHEN 'aligned' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) / count(*) + 1e-9, 4) AS confidence FROM claims GROUP BY paper")
def align_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.align_confidence(claims(spark, sf_dir))


@register("align_counts", f"WITH {CLAIMS} SELECT count(*) FILTER (status = 'aligned') AS aligned, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status IN ('missing', 'insufficient_evidence')) AS missing FROM claims")
def align_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return claims(spark, sf_dir).agg(F.count_if(s == "aligned").alias("aligned"), F.count_if(s == "partial").alias("partial"), F.count_if(s.isin("missing", "insufficient_evidence")).alias("missing"))


TOKENS_CLAIM = f"list_filter(list_transform(regexp_extract_all({{0}}, '[a-zA-Z0-9_]+|[一-鿿]{{{{1,8}}}}'), lambda t: lower(t)), lambda t: length(t) > 1 AND NOT list_contains({_list(config.CLAIM_STOP)}, t))"


@register("claim_tokens", f"SELECT item_id, array_to_string({TOKENS_CLAIM.format('text')}, ' ') AS tokens FROM benchmark")
def claim_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.claim_tokens(F.col("text")), " ").alias("tokens"))


_jc = [(1, 0, "regex pattern split in search"), (2, 0, "tokenize and chunk the text"), (3, 0, "向量 检索 vector search"), (4, 0, "nothing fits"), (5, 1, "parser core")]
_jp = [(0, "app/search/vector_store.py", 0), (0, "app/chunking/splitter.py", 1), (0, "lib/regex_parser.go", 2), (0, "docs/a.md", 3), (0, "app/core/tokenizer.rs", 4), (0, "x/search.py", 5), (1, "core/parser.py", 0), (1, "parser.py", 1), (1, "core/other.py", 2)]
_jx = [(0, "x/search.py")]
_groups = [[_list(a), _list(b), w] for a, b, w in R._EQUIVALENT]
BONUS = " + ".join(f"CASE WHEN len(list_filter({a}, lambda w: contains(lower(text), w))) > 0 AND len(list_filter({b}, lambda w: contains(lower(path), w))) > 0 THEN {w} ELSE 0.0 END" for a, b, w in _groups)


@register(
    "jit_candidates",
    f"""WITH {sql_values('c', 'qid int, session int, text string', _jc)}, {sql_values('p', 'session int, path string, pos int', _jp)}, {sql_values('x', 'session int, path string', _jx)},
s AS (SELECT qid, path, pos, len(list_filter({TOKENS_CLAIM.format('text')}, lambda t: contains(lower(path), t))) + {BONUS} AS score FROM c JOIN p USING (session) WHERE (session, path) NOT IN (SELECT (session, path) FROM x))
SELECT qid, path, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, length(path), pos) AS rank FROM s WHERE score > 0) WHERE rank <= 3""",
)
def jit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.jit_candidates(literals(spark, "qid int, session int, text string", _jc), literals(spark, "session int, path string, pos int", _jp), literals(spark, "session int, path string", _jx))
    return got.withColumn("rank", F.col("rank").cast("long"))


@register("evidence_spans", f"WITH {CORPUS}, {Q}, {bm25_sql('b', 'q', 5)} SELECT qid, rank, file, 1 AS start_line, 1 + length(text) - length(replace(text, chr(10), '')) AS end_line, left(text, 500) AS snippet, round(score, 6) AS score FROM b JOIN docs USING (doc_id) WHERE trim(text) <> ''")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefall.operators.retrieval import bm25_search

    d = docs_view(spark, sf_dir)
    hits = bm25_search(asked(spark, sf_dir), d, 5).join(d, "doc_id").select("qid", "rank", "file", F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("text").alias("content"), "score")
    return R.evidence_spans(hits, 5).withColumn("rank", F.col("rank").cast("long")).withColumn("end_line", F.col("end_line").cast("long"))


_md = [
    (1, "See [Paper](https://arxiv.org/abs/1706.03762) and https://arxiv.org/pdf/1706.03762.pdf and [x](https://example.org/a.pdf)."),
    (2, "https://openreview.net/forum?id=Ab-1 [T](https://openreview.net/pdf?id=Cd_2) http://site.net/p.pdf?dl=1"),
    (3, "no links"), (4, ""), (5, "https://arxiv.org/abs/2001.1 https://arxiv.org/abs/2001.1 HTTPS://ARXIV.ORG/pdf/9.9"),
]


def _links_sql() -> str:
    def part(rule: int, pattern: str, expr: str, source: str, fallback: str, where: str = "true") -> str:
        return f"SELECT id, {rule} AS rule, i, {expr} AS url, '{source}' AS source, '{fallback}' AS fallback FROM (SELECT id, unnest(u) AS u, unnest(range(len(u))) AS i FROM (SELECT id, regexp_extract_all(md, {sql_text(pattern)}) AS u FROM t)) WHERE {where}"

    pdf = lambda e: f"CASE WHEN ends_with({e}, '.pdf') THEN {e} ELSE {e} || '.pdf' END"
    parts = [
        part(1, config.ARXIV_PDF, pdf("u"), "arxiv", "arXiv PDF"), part(2, config.ARXIV_ABS, pdf("replace(u, '/abs/', '/pdf/')"), "arxiv", "arXiv PDF"),
        part(3, config.OPENREVIEW, "replace(u, 'forum?', 'pdf?')", "openreview", "OpenReview PDF"),
        part(4, config.GENERIC_PDF, "u", "pdf", "Paper PDF", "NOT contains(regexp_extract(u, '://([^/?#]*)', 1), 'arxiv.org') AND NOT contains(regexp_extract(u, '://([^/?#]*)', 1), 'openreview.net')"),
    ]
    return f"""WITH {sql_values('t', 'id int, md string', _md)}, f AS ({' UNION ALL '.join(parts)}),
o AS (SELECT *, rtrim(url, '/') AS canon, row_number() OVER (PARTITION BY id, rtrim(url, '/') ORDER BY rule, i) AS n FROM f),
titles AS (SELECT id, regexp_extract(l, '^\\[([^\\]]*)\\]', 1) AS title, regexp_extract(l, '\\((.*)\\)$', 1) AS url FROM (SELECT id, unnest(regexp_extract_all(md, '\\[[^\\]]*\\]\\(https?://[^\\s)]+\\)')) AS l FROM t))
SELECT o.id, canon AS url, trim(coalesce(nullif(title, ''), fallback)) AS title, source, row_number() OVER (PARTITION BY o.id ORDER BY rule, i) AS rank FROM o LEFT JOIN titles ON titles.id = o.id AND titles.url = o.url WHERE n = 1"""


@register("paper_links", _links_sql())
def paper_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paper_links(literals(spark, "id int, md string", _md), "id", "md").withColumn("rank", F.col("rank").cast("long"))


@register("page_links", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS h FROM pages) GROUP BY page_id")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("h"))
    return p.groupBy("page_id").agg(F.count("*").alias("n"))


# (url, normalized, owner, repo) by hand: the expected values are the oracle.
_urls = [
    ("https://github.com/Owner/Repo", "https://github.com/owner/repo", "Owner", "Repo"),
    ("https://github.com/Owner/Repo.git", "https://github.com/owner/repo", "Owner", "Repo"),
    ("https://github.com/owner/repo/tree/main?x=1#y", "https://github.com/owner/repo", "owner", "repo"),
    ("git@github.com:Owner/Repo.git", "https://github.com/owner/repo", "Owner", "Repo"),
    ("github.com/owner/repo", "https://github.com/github.com/owner", "owner", "repo"),
    ("https://www.github.com/owner/repo", "https://github.com/owner/repo", "owner", "repo"),
    ("owner/repo.git", "https://github.com/owner/repo", "owner", "repo"),
    ("https://example.com/owner/repo", "https://github.com/owner/repo", None, None),
    ("https://github.com/owner", "https://github.com/owner", None, None),
    ("  HTTPS://GitHub.com/A/B/  ", "https://github.com/a/b", "A", "B"),
]
_U = "url string, normalized string, owner string, repo string"


@register("url_normalize", f"WITH {sql_values('t', _U, _urls)} SELECT url, normalized FROM t")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, _U, _urls).select("url", ids.normalize_repo_url(F.col("url")).alias("normalized"))


@register("parse_repo_url", f"WITH {sql_values('t', _U, _urls)} SELECT url, owner, repo FROM t")
def parse_repo_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = literals(spark, _U, _urls).select("url", ids.parse_repo_url(F.col("url")).alias("r"))
    return got.select("url", "r.owner", "r.repo")


@register("session_id", f"WITH {sql_values('t', _U, _urls)} SELECT url, 'repo_' || left(sha256(normalized), 8) || '_' || left(regexp_replace(o, '[^a-zA-Z0-9]', '', 'g'), 10) || '_' || left(regexp_replace(r, '[^a-zA-Z0-9]', '', 'g'), 15) AS session FROM (SELECT *, CASE WHEN len(p) >= 2 THEN p[1] ELSE '' END AS o, CASE WHEN len(p) >= 2 THEN p[2] ELSE '' END AS r FROM (SELECT *, string_split(substr(normalized, 20), '/') AS p FROM t))")
def session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, _U, _urls).select("url", ids.session_id(F.col("url")).alias("session"))


@register("session_prefix", f"WITH {sql_values('t', _U, _urls)} SELECT url, starts_with(url, 'repo_') AS is_session FROM t")
def session_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, _U, _urls).select("url", F.col("url").startswith("repo_").alias("is_session"))


@register("lock_key", f"WITH {sql_values('t', _U, _urls)}, k AS (SELECT url, CASE WHEN owner IS NOT NULL THEN 'https://github.com/' || lower(owner) || '/' || lower(repo) ELSE normalized END AS src, CASE WHEN owner IS NOT NULL THEN lower(owner) WHEN len(p) >= 2 THEN p[1] ELSE '' END AS o, CASE WHEN owner IS NOT NULL THEN lower(repo) WHEN len(p) >= 2 THEN p[2] ELSE '' END AS r FROM (SELECT *, string_split(substr(normalized, 20), '/') AS p FROM t)) SELECT url, 'repo_lock_' || left(sha256(src), 10) || '_' || coalesce(nullif(left(regexp_replace(o, '[^a-zA-Z0-9]', '', 'g'), 20), ''), 'unknown') || '_' || coalesce(nullif(left(regexp_replace(r, '[^a-zA-Z0-9]', '', 'g'), 30), ''), 'unknown') AS key FROM k")
def lock_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark, _U, _urls).select("url", ids.lock_key(F.col("url")).alias("key"))


@register("point_id", "SELECT doc_id, CAST(CAST('0x' || substr('0123456701234567', strpos('0123456789abcdef', left(h, 1)), 1) || substr(h, 2, 15) AS UBIGINT) AS BIGINT) AS point FROM (SELECT doc_id, sha256(source || '/' || doc_id) AS h FROM documents)")
def point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_view(spark, sf_dir).select("doc_id", ids.point_id(F.col("file")).alias("point"))


@register("eval_key", "SELECT conv_id, turn, conv_id || ':' || left(md5(text), 8) AS key FROM conversations")
def eval_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", ids.eval_key(F.col("text"), F.col("conv_id").cast("string")).alias("key"))


@register("pdf_hosts", "SELECT page_id, regexp_matches(url, '^https?://') AND (h = 'example.org' OR ends_with(h, '.example.org')) AS allowed FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#:]*)', 1) AS h FROM pages)")
def pdf_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact host or a subdomain of it, by http or https."""
    host = F.regexp_extract("url", "://([^/?#:]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", (F.col("url").rlike("^https?://") & ((host == "example.org") | host.endswith(".example.org"))).alias("allowed"))
