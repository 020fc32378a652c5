"""Recorded model replies: parsing with defaults, and texts for prompts and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orefall.functions import text as X
from orefall.functions.scores import clamp

JUDGED = "status string, matched_files array<string>, matched_symbols array<string>, evidence_excerpt string, reason string"
STATUSES = ("aligned", "partial", "missing", "insufficient_evidence")


def judged(reply: Column, hit_files: Column) -> Column:
    """struct(status, files, excerpt, reason): an unknown status is missing, no files are the first five hit files, no JSON is insufficient evidence."""
    got = F.from_json(X.strip_fences(reply), JUDGED)
    readable = F.from_json(X.strip_fences(reply), "map<string,string>").isNotNull()
    status = F.when(~F.coalesce(readable, F.lit(False)), "insufficient_evidence").when(got["status"].isin(*STATUSES), got["status"]).otherwise("missing")
    files = F.when(F.coalesce(F.size(got["matched_files"]), F.lit(0)) > 0, got["matched_files"]).otherwise(F.slice(hit_files, 1, 5))
    return F.struct(status.alias("status"), files.alias("files"), F.substring(F.coalesce(got["evidence_excerpt"], F.lit("")), 1, 300).alias("excerpt"), F.coalesce(got["reason"], F.lit("")).alias("reason"))


def claims(reply: Column, most: int = 10) -> Column:
    """The non-blank claims of a reply, trimmed."""
    got = F.from_json(X.strip_fences(reply), "claims array<string>")["claims"]
    kept = F.filter(F.transform(got, lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    return F.slice(F.coalesce(kept, F.array().cast("array<string>")), 1, most)


def risks(reply: Column) -> Column:
    """struct(summary, titles): the fixed text and no risks for a reply that is missing or not readable."""
    got = F.from_json(X.strip_fences(reply), "summary string, risks array<struct<title:string,reason:string>>")
    titles = F.transform(F.coalesce(got["risks"], F.array().cast("array<struct<title:string,reason:string>>")), lambda r: F.substring(r["title"], 1, 200))
    return F.struct(F.coalesce(got["summary"], F.lit("rule-based score only")).alias("summary"), titles.alias("titles"))


def routes(reply: Column, claim: Column) -> Column:
    """The claim and the rewritten queries that differ from it and each other without regard to case: (text, weight)."""
    got = F.from_json(X.strip_fences(reply), "queries struct<keyword_compact:string,implementation_view:string,synonym_expansion:string>")["queries"]
    pairs = F.array(
        F.struct(F.trim(claim).alias("text"), F.lit(1.0).alias("weight")), F.struct(F.trim(got["keyword_compact"]).alias("text"), F.lit(0.82).alias("weight")),
        F.struct(F.trim(got["implementation_view"]).alias("text"), F.lit(0.78).alias("weight")), F.struct(F.trim(got["synonym_expansion"]).alias("text"), F.lit(0.72).alias("weight")),
    )
    full = F.filter(pairs, lambda p: p["text"].isNotNull() & (p["text"] != ""))
    return F.filter(full, lambda p, i: F.array_position(F.transform(full, lambda q: F.lower(q["text"])), F.lower(p["text"])) == i + 1)


def questions(reply: Column, defaults: tuple[str, str, str]) -> Column:
    """Three questions: from named fields or a list of three at least; blanks and repeats become the defaults."""
    got = F.from_json(X.strip_fences(reply), "macro string, implementation string, reproduction string, questions array<string>")
    listed = F.coalesce(F.size(got["questions"]), F.lit(0)) >= 3
    raw = [F.trim(F.coalesce(got[name], F.when(listed, F.get(got["questions"], F.lit(i))))) for i, name in enumerate(("macro", "implementation", "reproduction"))]
    out: list[Column] = []
    for i, q in enumerate(raw):
        repeat = X.any_of(*[F.coalesce(F.lower(q) == F.lower(p), F.lit(False)) for p in raw[:i]])
        out.append(F.when(X.blank(q) | repeat, defaults[i]).otherwise(q))
    return F.array(*out)


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def paired_mean(a: Column, b: Column) -> Column:
    """Mean of two measures, either one standing for a missing other."""
    return (F.coalesce(a, b) + F.coalesce(b, a)) / 2


def ui_status(status: Column) -> Column:
    return F.when(status == "insufficient_evidence", "missing").otherwise(status)


def jit_status(loaded: Column, failed: Column, asked: Column) -> Column:
    rest = F.greatest(F.lit(0), asked - loaded - failed)
    return F.when(asked == 0, "nothing to load").otherwise(F.format_string("loaded %d, failed %d, remaining %d", loaded, failed, rest))


def message_class(error: Column) -> Column:
    low = F.lower(error)
    return (
        F.when(low.contains("401") | low.contains("unauthorized"), "auth").when(low.contains("403") | low.contains("rate limit"), "rate_limit")
        .when(low.contains("404") | low.contains("not found"), "not_found").when(low.contains("timeout") | low.contains("timed out"), "timeout").otherwise("other")
    )


def score_number(reply: Column) -> Column:
    return F.coalesce(clamp(F.regexp_extract(reply, "(\\d+\\.?\\d*)", 1).try_cast("double")), F.lit(0.5))
