"""URL filter: allow/block rules, and a listing behind a blocked Bloom filter.

Listed canonical URLs set bits in a Bloom filter of 256-bit blocks (eight lanes of 32 bits,
one bit a lane). A page's URL reads one block; only possible hits go on to the exact hash
join with the listing, which removes the filter's false positives. Everything is built-in
expressions. The filter is a table of blocks: it is broadcast behind a check of its size and
joined on the block number beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.llm.common import store

# The rules of the registered query.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# The registered query's listing is made by this rule: each of these names under each subdomain and
# domain, with the pages numbered up to LISTED_PAGES in each language. Pages of higher numbers, other
# endings or other hosts are near-matches that must pass.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm", *(a + b for a in ("thth", "ther") for b in ("an", "en", "es", "ha", "nt", "ti")))
LISTED_SUBDOMAINS = ("", "blog.", "m.")
LISTED_DOMAINS = ("com", "net", "org")
LISTED_LANGUAGES = ("de", "en", "es", "fr")
LISTED_PAGES = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without scheme, query, fragment, default port, leading ``www.`` and trailing slashes."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", ""), F.regexp_replace(path, "/+$", ""))


def under_host(host: Column, name: str) -> Column:
    return (host == name) | host.endswith("." + name)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = under_host(host, name) & path.startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _slot(canon: Column, blocks: int) -> list[Column]:
    spots = F.xxhash64(F.lit("lanes"), canon)
    lanes = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spots, 5 * i).bitwiseAND(F.lit(31).cast("long")).cast("int")).alias(f"bit{i}") for i in range(LANES)]
    return [F.pmod(F.xxhash64(canon), F.lit(blocks).cast("long")).alias("block"), *lanes]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, lane0..lane7) of the canonical URLs in column canon; empty blocks have no row."""
    return listed.select(*_slot(F.col("canon"), blocks)).groupBy("block").agg(*[F.bit_or(f"bit{i}").alias(f"lane{i}") for i in range(LANES)])


def _possible(seen: DataFrame, filter_blocks: DataFrame, blocks: int, broadcast: bool, salts: int) -> DataFrame:
    """``seen`` with a column possible: no rule decides and the Bloom filter has the canonical URL."""
    full = F.lit(True)
    for i in range(LANES):
        full = full & (F.col(f"lane{i}").bitwiseAND(F.col(f"bit{i}")) != 0)
    slots = seen.select("*", *_slot(F.col("canon"), blocks))
    probed = slots.join(F.broadcast(filter_blocks), "block", "left") if broadcast else _salted(slots, filter_blocks, "block", salts)
    return probed.select(*seen.columns, (F.col("ruled").isNull() & F.coalesce(full, F.lit(False))).alias("possible"))


def _salted(rows: DataFrame, table: DataFrame, key: str, salts: int) -> DataFrame:
    """Left join on ``key`` in which the rows of one key are spread over ``salts`` tasks."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    right = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "salt"], "left").drop("salt")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, bits_per_url: int = 12, broadcast_bytes: int = 32 << 20, salts: int = 16) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    ``listed`` has a column url. A rule decides where one fits; else a listed canonical URL
    is blocked and any other allowed. Null urls and urls without ``://`` have empty host and
    path and are allowed, also if such urls are listed. Repeated rows each get a row, other
    columns are ignored, and either table may be empty.

    ``pages`` is read twice: the distinct URLs that pass the Bloom filter are joined with the
    listing, and then each page with those that this confirms. The blocks of the filter and
    the confirmed URLs are broadcast up to ``broadcast_bytes``; beyond, the joins are salted,
    so that a URL with a third of all pages is no task's own.
    """
    listed = listed.select(canonical(url_host(F.col("url")), url_path(F.col("url"))).alias("canon")).where("canon <> ''").distinct()
    listed = store(listed, "listed-urls")
    blocks = max(1, -(-listed.count() * bits_per_url // (32 * LANES)))
    filter_blocks = store(bloom_blocks(listed, blocks), "bloom-blocks")
    small_filter = blocks * 8 * (LANES + 1) <= broadcast_bytes
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = seen.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumn("canon", canonical(F.col("host"), F.col("path")))

    asked = _possible(seen, filter_blocks, blocks, small_filter, salts).where("possible").select("canon").distinct()
    confirmed = store(asked.join(listed, "canon", "left_semi").withColumn("listed", F.lit(True)), "confirmed-urls")
    size = confirmed.agg(F.coalesce(F.sum(F.octet_length("canon") + 16), F.lit(0))).head()[0]
    out = ["page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict")]
    if size <= broadcast_bytes:
        return seen.join(F.broadcast(confirmed), "canon", "left").select(*out)
    probed = _possible(seen, filter_blocks, blocks, small_filter, salts)
    passed = probed.where("not possible").withColumn("listed", F.lit(None).cast("boolean")).select(*out)
    return passed.unionByName(_salted(probed.where("possible"), confirmed, "canon", salts).select(*out))


def listed_urls(spark: SparkSession, pages: int = LISTED_PAGES) -> DataFrame:
    """The listing of the registered query, by its rule."""
    stems = [f"http://{sub}{name}.example.{domain}/{lang}/" for name in LISTED_NAMES for sub in LISTED_SUBDOMAINS for domain in LISTED_DOMAINS for lang in LISTED_LANGUAGES]
    numbers = spark.range(1, pages + 1).select("id", F.explode(F.array(*map(F.lit, stems))).alias("stem"))
    return numbers.select(F.concat("stem", F.col("id").cast("string")).alias("url"))


def oracle(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """DuckDB SQL for the registered query."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')", rule, verdict))
    rule_sql = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    verdict_sql = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    parts = {"name": LISTED_NAMES, "sub": LISTED_SUBDOMAINS, "domain": LISTED_DOMAINS, "lang": LISTED_LANGUAGES}
    sources = ", ".join(f"(SELECT unnest({list(values)}) AS {name})" for name, values in parts.items())
    return f"""
WITH seen AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
canon AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '') || regexp_replace(path, '/+$', '') AS canon FROM seen),
listed AS (SELECT sub || name || '.example.' || domain || '/' || lang || '/' || n AS canon FROM {sources}, (SELECT unnest(range(1, {LISTED_PAGES + 1})) AS n))
SELECT page_id, host, path, CASE {rule_sql} END AS rule,
       CASE {verdict_sql} WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM canon
"""
