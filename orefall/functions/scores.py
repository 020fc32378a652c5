"""Judges and scores of rewritten queries, answers and agent runs; tiers; combined scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orefall import config


def r6(value: Column | str) -> Column:
    """Rounded to six digits, ties upward: a nudge of a billionth takes values off the tie, where engines differ."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-9, 6)


def r2(value: Column) -> Column:
    """Rounded to two digits as the SQL engine does it: a hundredfold in double precision, its ties away from zero (0.575 gives 0.57, as 57.49999999999999 is below the tie)."""
    many = F.abs(value) * 100
    whole = F.floor(many)
    return F.signum(value) * (whole + F.when(many - whole >= 0.5, 1).otherwise(0)) / 100


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def lowered(text: Column) -> Column:
    """Lower-cased sign by sign as the SQL engine does it: a sigma at a word's end is as any other, a dotted capital I becomes one sign."""
    return F.lower(F.replace(F.replace(text, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def words(text: Column) -> Column:
    """Distinct lower-cased words, split at blanks, tabs and ends of lines and pages (not at vertical tabs, as in the SQL)."""
    return F.array_distinct(F.filter(F.split(lowered(text), "[ \\t\\n\\f\\r]+"), lambda w: w != ""))


def content_words(answer: Column) -> Column:
    return F.array_except(words(answer), F.array(*map(F.lit, config.JUDGE_STOP)))


def found_share(found: Column, content: Column) -> Column:
    """Faithfulness from the number of content words and of those found."""
    return F.when(content == 0, 0.7).otherwise(F.least(F.lit(1.0), ratio(found, content) + 0.2))


def faithfulness(context: Column, answer: Column) -> Column:
    """Share of an answer's content words that occur in the context as substrings, plus 0.2, at most 1; 0.7 without any."""

    def share(x: Column) -> Column:
        return found_share(F.size(F.filter(x["content"], lambda w: F.contains(x["context"], w))), F.size(x["content"]))

    # A list of one, so that words are cut and the context is lower-cased once for a row, not once for each word.
    return F.transform(F.array(F.struct(content_words(answer).alias("content"), lowered(context).alias("context"))), share)[0]


def relevance(query: Column, answer: Column) -> Column:
    """Share of the query's words that the answer has, plus 0.3, at most 1."""
    q = words(query)
    return F.least(F.lit(1.0), ratio(F.size(F.array_intersect(q, words(answer))), F.greatest(F.size(q), F.lit(1))) + 0.3)


def completeness(answer: Column) -> Column:
    n = F.length(answer)
    return F.when(n < 50, 0.3).when(n < 200, 0.6).otherwise(0.9)


def generation_score(faithful: Column, relevant: Column, complete: Column, code: Column, hallucinations: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.35 * faithful + 0.35 * relevant + 0.2 * complete + 0.1 * code - 0.1 * hallucinations)


def rewrite_metrics(original: Column, rewritten: Column) -> dict[str, Column]:
    a, b = words(original), words(rewritten)
    shared = F.size(F.array_intersect(a, b))
    coverage = ratio(shared, F.size(a))
    diversity = F.least(F.lit(1.0), ratio(F.size(F.array_except(b, a)), F.greatest(F.size(a), F.lit(1))))
    preserved = F.least(F.lit(1.0), coverage + 0.2)
    return {"coverage": coverage, "preservation": preserved, "diversity": diversity, "overall": 0.4 * coverage + 0.4 * preserved + 0.2 * diversity}


def efficiency(steps: Column, redundant: Column, backtracks: Column) -> Column:
    return F.when(steps == 0, 0.0).otherwise(clamp(1 - ratio(redundant, steps) - 0.1 * backtracks))


def agentic_score(selection: Column, parameters: Column, effective: Column, success: Column) -> Column:
    return 0.4 * selection + 0.3 * parameters + 0.2 * effective + 0.1 * success


def tier(score: Column) -> Column:
    out = F.lit("rejected")
    for name, least in reversed(config.TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def tier_floor(name: Column) -> Column:
    out = F.lit(0.0)
    for known, least in config.TIERS:
        out = F.when(name == known, least).otherwise(out)
    return out


def level(raw: Column) -> Column:
    return F.when(raw >= 0.8, "high").when(raw >= 0.6, "medium").otherwise("low")


LAYERS = (("rewrite", 0.15), ("retrieval", 0.35), ("generation", 0.4), ("agentic", 0.1))


def overall(**layers: Column) -> Column:
    """Weighted mean over the layers that are present; 0 without any."""
    weights = dict(LAYERS)
    total, share = F.lit(0.0), F.lit(0.0)
    for name, value in layers.items():
        total = total + F.coalesce(value * weights[name], F.lit(0.0))
        share = share + F.when(value.isNotNull(), weights[name]).otherwise(0.0)
    return F.coalesce(F.try_divide(total, share), F.lit(0.0))


def final_score(custom: Column, second: Column) -> Column:
    """struct(score, status): the second score missing: normal; more than 0.2 apart: needs_review; else 0.7 and 0.3 of both."""
    mixed = F.round(0.7 * custom + 0.3 * second, 9)
    apart = F.round(F.abs(custom - second), 9) > 0.2
    score = F.when(second.isNull() | apart, custom).otherwise(mixed)
    status = F.when(second.isNull(), "normal").when(apart, "needs_review").when((custom > 0.75) & (second > 0.75), "high_confidence").otherwise("normal")
    return F.struct(score.alias("score"), status.alias("status"))


def judged_number(reply: Column) -> Column:
    """The first number of a judge's reply between 0 and 1; 0.5 where there is none."""
    return F.coalesce(clamp(F.regexp_extract(reply, "(\\d+\\.?\\d*)", 1).try_cast("double")), F.lit(0.5))
