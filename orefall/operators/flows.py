"""End-to-end flows: cached replies replayed, retrieval with files indexed just in time, event lines.

Replies of models are tables that the caller has recorded; a flow joins them where the
service would ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefall.functions import text as X
from orefall.operators import repo as Repo
from orefall.operators import retrieval as R

JIT_FILES = 3
RETRY = ("missing", "insufficient_evidence")


def replayed(asked: DataFrame, cache: DataFrame, made: DataFrame, keys: list[str], owner: list[str], size: int = 900) -> DataFrame:
    """(keys, cached, pos, part): the cached payload of each request in parts, else what is made for its owner.

    ``cache`` has (keys, payload), ``made`` (owner, payload), at most one row each; a request
    with neither has no part.
    """
    rows = asked.join(cache.select(*keys, F.col("payload").alias("hit")), keys, "left").join(made.select(*owner, "payload"), owner, "left")
    parts = F.posexplode(X.rechunk(F.coalesce("hit", "payload"), size)).alias("pos", "part")
    return rows.select(*keys, F.col("hit").isNotNull().alias("cached"), parts)


def page(rows: DataFrame, owner: list[str], newest: list[Column], line: Column, most: int, oldest_first: bool = False) -> DataFrame:
    """(owner, payload): the lines of the ``most`` newest rows of each owner, one below another; what is kept of an owner is bounded."""
    number = F.row_number().over(Window.partitionBy(*owner).orderBy(*newest))
    kept = rows.withColumn("_n", number).where(F.col("_n") <= most).withColumn("_line", line)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("_n") if oldest_first else F.col("_n")).alias("n"), F.col("_line").alias("line"))))
    return kept.groupBy(*owner).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("payload"))


def jit_round(asked: DataFrame, files: DataFrame, indexed: DataFrame, limit: int = JIT_FILES) -> DataFrame:
    """(qid, path, doc_id, fetched): the files that a round fetches for each request (qid, session, text), best first.

    ``files`` has (session, path, pos, doc_id, text), ``indexed`` (session, path); an empty
    text fails and is not indexed.
    """
    wanted = Repo.jit_candidates(asked, files.select("session", "path", "pos"), indexed, limit).select("qid", "path")
    found = wanted.join(asked.select("qid", "session"), "qid").join(files.select("session", "path", "doc_id", "text"), ["session", "path"])
    return found.select("qid", "session", "path", "doc_id", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("fetched"))


def align(claims: DataFrame, files: DataFrame, indexed: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """One row a claim (qid, paper, hits, jit_files, post_hits, status): retrieve, judge, fetch and judge again.

    ``claims`` has (qid, paper, session, text), ``files`` (session, path, pos, doc_id, text),
    ``indexed`` the (session, path) that retrieval knows at first, ``judged`` the recorded
    replies (qid, round, status), rounds 0 and 1. Claims that are missing or without evidence
    in round 0 fetch files; where one was indexed they retrieve and are judged once more,
    over all that the claims of this run have fetched.
    """
    known = files.join(indexed, ["session", "path"], "left_semi").select("doc_id", "text")
    ask = claims.select("qid", "text")
    hits = R.stored(R.bm25_search(ask, known, k).groupBy("qid").agg(F.count("*").cast("int").alias("hits")), "align-hits")
    first = judged.where("round = 0").select("qid", F.col("status").alias("first"))
    second = judged.where("round = 1").select("qid", F.col("status").alias("second"))
    open_ = claims.join(first.where(F.col("first").isin(*RETRY)), "qid", "left_semi")
    fetched = R.stored(jit_round(open_.select("qid", "session", "text"), files, indexed), "align-jit")
    added = fetched.where("fetched").groupBy("qid").agg(F.count("*").cast("int").alias("jit_files"))
    more = known.unionByName(files.join(fetched.where("fetched").select("session", "path").distinct(), ["session", "path"], "left_semi").select("doc_id", "text"))
    again = R.bm25_search(ask.join(added, "qid", "left_semi"), more, k).groupBy("qid").agg(F.count("*").cast("int").alias("post_hits"))
    rows = claims.select("qid", "paper").join(hits, "qid", "left").join(first, "qid", "left").join(added, "qid", "left").join(again, "qid", "left").join(second, "qid", "left")
    status = F.when(F.col("jit_files").isNotNull(), F.coalesce("second", "first")).otherwise(F.col("first"))
    return rows.select("qid", "paper", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("jit_files", F.lit(0)).alias("jit_files"), "post_hits", F.coalesce(status, F.lit("insufficient_evidence")).alias("status"))


def event_lines(events: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """(key, order, line): events as JSON lines; the first that does not serialise (a null payload) becomes one error line and ends its stream."""
    failed = F.when(payload.isNull(), F.col(order))
    ends = F.min(failed).over(Window.partitionBy(key))
    rows = events.withColumn("_line", payload).withColumn("_end", ends).where(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    error = F.to_json(F.struct(F.lit("error").alias("type"), F.lit("serialization failed").alias("message")))
    return rows.select(key, order, F.coalesce("_line", error).alias("line"))


def rounds(asked: DataFrame, limit: int = 4) -> DataFrame:
    """(key, round, status) of ``asked`` (key, round, n_new): a key's rounds until one brings nothing new, ``limit`` at most."""
    stop = F.min(F.when(F.col("n_new") == 0, F.col("round"))).over(Window.partitionBy("key"))
    kept = asked.where(F.col("round") <= limit).withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("round") <= F.col("_stop")))
    return kept.select("key", "round", F.when(F.col("round") == F.col("_stop"), "stopped").when(F.col("round") == limit, "limit").otherwise("continued").alias("status"))
