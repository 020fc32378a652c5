"""Parsers over table data: their inputs are put together from the rows, so the SQL knows the results without parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.functions import ids
from orefall.functions import text as X
from orefall.operators import repo as R
from orefall.plans.registry import register
from orefall.plans.views import read

OWNED = "o AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '[^a-z]', '', 'g') AS owner, 'r' || page_id AS repo FROM pages)"


@register(
    "repo_ids_of_pages",
    f"""WITH {OWNED}, n AS (SELECT *, 'https://github.com/' || owner || '/' || repo AS norm, unnest(range(4)) AS form FROM o WHERE owner <> '')
SELECT page_id, form, norm, owner || '/' || repo AS parsed, 'repo_' || left(sha256(norm), 8) || '_' || left(owner, 10) || '_' || left(repo, 15) AS session,
       'repo_lock_' || left(sha256(norm), 10) || '_' || left(owner, 20) || '_' || left(repo, 30) AS key FROM n""",
)
def repo_ids_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four spellings of a repository for each page, all with the same ids."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    o = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(host, "[^a-z]", "").alias("owner"), F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("repo")).where("owner <> ''")
    path = F.concat("owner", F.lit("/"), "repo")
    forms = F.array(
        F.concat(F.lit("https://github.com/"), path), F.concat(F.lit("git@github.com:"), path, F.lit(".git")), F.concat(F.lit("  https://github.com/"), path, F.lit("/ ")), F.concat(F.lit("https://github.com/"), path, F.lit("/tree/main?tab=readme#top")),
    )
    u = o.select("page_id", F.posexplode(forms).alias("form", "url"))
    got = ids.parse_repo_url(F.col("url"))
    return u.select(
        "page_id", F.col("form").cast("long").alias("form"), ids.normalize_repo_url(F.col("url")).alias("norm"), F.concat(got["owner"], F.lit("/"), got["repo"]).alias("parsed"),
        ids.session_id(F.col("url")).alias("session"), ids.lock_key(F.col("url")).alias("key"),
    )


SAID = "w AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[a-zA-Z]+')[1:5], lambda x: lower(x)) AS words FROM conversations)"


@register(
    "replies_of_conversations",
    f"WITH {SAID} SELECT conv_id, turn, form, array_to_string(words, '|') AS items, array_to_string(list_transform(words, lambda x: x || '.py'), '|') AS paths FROM (SELECT *, unnest(range(3)) AS form FROM w) WHERE len(words) > 0",
)
def replies_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a JSON list of a turn's words, bare, fenced and amid text, and with tool tags."""
    words = F.transform(F.slice(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), F.lit(1)), 1, 5), F.lower)
    w = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words")).where("size(words) > 0")
    listed = F.to_json("words")
    forms = F.array(listed, F.concat(F.lit("```json\n"), listed, F.lit("\n```")), F.concat(F.lit("Sure, here: "), listed, F.lit(" as asked.")))
    tags = F.array_join(F.transform("words", lambda x: F.concat(F.lit("see <tool_code>`"), x, F.lit(".py`</tool_code>"))), "\n")
    r = w.withColumn("tags", tags).select("conv_id", "turn", "tags", F.posexplode(forms).alias("form", "raw"))
    return r.select("conv_id", "turn", F.col("form").cast("long").alias("form"), F.array_join(X.json_list(F.col("raw")), "|").alias("items"), F.array_join(X.tool_paths(F.col("tags")), "|").alias("paths"))


@register(
    "paper_links_of_documents",
    """WITH t AS (SELECT doc_id, regexp_extract(text, '[a-zA-Z]+') AS word FROM documents)
SELECT doc_id, 'https://arxiv.org/pdf/' || doc_id || '.5.pdf' AS url, CASE WHEN word <> '' THEN word ELSE 'arXiv PDF' END AS title, 'arxiv' AS source, 1 AS rank FROM t
UNION ALL SELECT doc_id, 'https://openreview.net/pdf?id=' || doc_id, 'OpenReview PDF', 'openreview', 2 FROM t UNION ALL SELECT doc_id, 'http://site.org/' || doc_id || '.pdf', 'Paper PDF', 'pdf', 3 FROM t""",
)
def paper_links_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A README for each document, with three papers, one of them twice."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    word = F.coalesce(F.regexp_extract("text", "[a-zA-Z]+", 0), F.lit(""))
    md = F.concat(
        F.lit("Read http://site.org/"), i, F.lit(".pdf, ["), word, F.lit("](https://arxiv.org/pdf/"), i, F.lit(".5.pdf) or https://arxiv.org/abs/"), i, F.lit(".5 and https://openreview.net/forum?id="), i, F.lit(" too.")
    )
    return R.paper_links(d.select("doc_id", md.alias("md")), "doc_id", "md").select("doc_id", "url", "title", "source", F.col("rank").cast("int").alias("rank"))
