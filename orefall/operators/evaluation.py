"""Gates, routing, cleaning, samples for training, and analysis of evaluation results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from orefall import config
from orefall.functions import scores as S
from orefall.functions import text as X
from orefall.functions.scores import r6


def online_reason(query: Column, context: Column, answer: Column, repo_url: Column) -> Column:
    """The first rule of the online gate that fails, or null."""
    return (
        F.when(query.isNull() | (F.trim(query) == ""), "query_empty")
        .when(F.length(F.trim(query)) < 10, "query_too_short")
        .when(X.is_chatty(query), "chatty_query")
        .when(X.blank(repo_url), "missing_repo_url")
        .when(answer.isNull() | (F.length(F.trim(answer)) < 100), "answer_too_short")
        .when(~X.shows_code(context), "no_code_in_context")
    )


def offline_reason(query: Column, context: Column, answer: Column, repo_url: Column, score: Column, faithful: Column, relevant: Column, c: config.Cleaning = config.CLEANING) -> Column:
    """The first rule of the cleaning gate that fails, with its value, or ``passed``. Lengths are of the texts as they are."""
    two = lambda name, x: F.concat(F.lit(name + ":"), F.format_string("%.2f", S.r2(x)))
    n = lambda name, x: F.concat(F.lit(name + ":"), F.length(x).cast("string"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return (
        F.when(X.blank(query), "missing_query")
        .when(answer.isNull(), "missing_generation")
        .when(X.blank(repo_url), "missing_repo_url")
        .when(zero(score) < c.min_score, two("low_score", zero(score)))
        .when(zero(faithful) < c.min_faithfulness, two("low_faithfulness", zero(faithful)))
        .when(zero(relevant) < c.min_relevance, two("low_relevance", zero(relevant)))
        .when(F.length(query) < c.min_query, n("short_query", query))
        .when(F.length(answer) < c.min_answer, n("short_answer", answer))
        .when(F.length(context) < c.min_context, n("short_context", context))
        .when(X.is_chatty(query), "chatty_query")
        .when(~X.shows_code(context), "no_code_in_context")
        .otherwise("passed")
    )


WIDE, BLOCK, PLAIN = 24, 1 << 20, 1 << 14  # bytes of a window, windows sorted at once, length up to which texts are searched word by word


def first_ends(text: bytes, words: set[bytes]) -> dict[bytes, int]:
    """Where the first occurrence of each word in a UTF-8 text ends, for those that occur.

    In long texts the windows at all places are sorted, so that a word is a range of them and
    many words do not each take a walk over the text.
    """
    if len(text) <= PLAIN or b"\0" in text:
        return {w: at + len(w) for w in words if (at := text.find(w)) >= 0}
    padded, ends, left = np.frombuffer(text + bytes(WIDE), np.uint8), {}, list(words)
    for begin in range(0, len(text), BLOCK):
        n = min(BLOCK, len(text) - begin)
        windows = np.lib.stride_tricks.sliding_window_view(padded[begin : begin + n + WIDE - 1], WIDE)
        windows = np.ascontiguousarray(windows).view(f"S{WIDE}").ravel()
        order = np.argsort(windows, kind="stable")
        ordered = windows[order]
        starts = np.array([w[:WIDE] for w in left], f"S{WIDE}")
        low = np.searchsorted(ordered, starts)
        high = np.searchsorted(ordered, np.array([w[:WIDE].ljust(WIDE, b"\xff") for w in left], f"S{WIDE}"), side="right")
        least = np.minimum.reduceat(np.append(order, n), np.column_stack([low, high]).ravel())[::2]
        for w, at in zip(left, np.where(high > low, least, -1).tolist(), strict=True):
            if at >= 0 and (at := begin + at if len(w) <= WIDE else text.find(w, begin + at)) >= 0:
                ends[w] = at + len(w)
        left = [w for w in left if w not in ends]
        if not left:
            break
    return ends


def found_earlier(said: DataFrame, group: str, order: str, text: str, wanted: str, gap: int = 1) -> DataFrame:
    """The rows without ``text`` and ``wanted``, with found: how many of the words ``wanted`` stand in the texts of the group at least ``gap`` rows before.

    Counts as ``contains`` on these texts joined by line ends, but no such context is made, so
    a long group takes time and memory in proportion to its length. Null texts are not said;
    found is null where ``wanted`` is. Rows of a group come in one partition, in order.
    """
    kept = [c for c in said.columns if c not in (text, wanted)]
    schema = StructType([said.schema[c] for c in kept]).add("found", IntegerType())

    def counts(texts: list[bytes | None], asked: list[list[bytes] | None]) -> list[int | None]:
        ends = first_ends(b"\n".join(t for t in texts if t is not None), {w for words in asked for w in words or ()})
        until, out = [], []
        length = -1
        for i, (t, words) in enumerate(zip(texts, asked, strict=True)):
            until.append(length)
            before = until[i - gap + 1] if i >= gap - 1 else -1
            out.append(None if words is None else sum(0 <= ends.get(w, -1) <= before for w in words))
            length += 0 if t is None else len(t) + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[int | None] = []
        key, texts, asked = None, [], []

        def ready() -> Iterator[pa.RecordBatch]:
            while held and len(found) >= held[0].num_rows:
                b = held.pop(0)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found[: b.num_rows], pa.int32())], names=schema.names)
                del found[: b.num_rows]

        for b in batches:
            held.append(b)
            words = b.column(wanted).cast(pa.list_(pa.binary()))
            for k, t, w in zip(b.column(group).to_pylist(), b.column(text).cast(pa.binary()).to_pylist(), words.to_pylist(), strict=True):
                if k != key and texts:
                    found.extend(counts(texts, asked))
                    texts, asked = [], []
                key = k
                texts.append(t)
                asked.append(w)
            yield from ready()
        found.extend(counts(texts, asked))
        yield from ready()

    parts = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return said.repartition(parts, group).sortWithinPartitions(group, order).mapInArrow(run, schema)


def scored(qa: DataFrame, faithful: Column | None = None) -> DataFrame:
    """Judged pairs: faithful (as given, else from context and answer), relevant, complete, generation score, overall score, tier, and whether it is fit for training."""
    q, c, a = F.col("query"), F.col("context"), F.col("answer")
    faithful = S.faithfulness(c, a) if faithful is None else faithful
    measures = F.struct(r6(faithful).alias("faithful"), r6(S.relevance(q, a)).alias("relevant"), S.completeness(a).alias("complete"))
    judged = qa.select("*", F.inline(F.array(measures)))  # a generator: filters on scores stay behind it, or each would take in the measures many times
    gen = S.generation_score(F.col("faithful"), F.col("relevant"), F.col("complete"), F.lit(1.0), F.lit(0))
    out = judged.withColumn("generation", r6(gen))
    return out.withColumn("score", F.col("generation")).withColumn("tier", S.tier(F.col("score"))).withColumn("sft_ready", F.col("score") >= 0.7)


def routed(rows: DataFrame, score: str = "score", recomputed: str = "generation") -> DataFrame:
    """(…, tier, sink): a score of exactly 0 is computed anew; gold and silver go to positive, bronze to negative, others nowhere."""
    s = F.when(F.col(score) == 0.0, F.col(recomputed)).otherwise(F.col(score))
    # A generator: else the tier and filters on it take in the score so often that no code can be made of the plan.
    out = rows.select(*[c for c in rows.columns if c != score], F.inline(F.array(F.struct(S.clamp(s).alias(score)))))
    out = out.withColumn("tier", S.tier(F.col(score)))
    return out.withColumn("sink", F.when(F.col("tier").isin("gold", "silver"), "positive").when(F.col("tier") == "bronze", "negative"))


def sft_input(query: Column, context: Column) -> Column:
    return F.concat(F.lit("[用户问题]\n"), query, F.lit("\n\n[代码上下文]\n"), context)


def sft_build(rows: DataFrame, n: config.SftLengths = config.SFT) -> DataFrame:
    """instruction, input, output and whether texts were cut; over the total length the context is cut anew."""
    query = X.safe_truncate(F.col("query"), n.query, "...")
    answer = X.safe_truncate(F.col("answer"), n.answer, config.ANSWER_CUT)
    first = rows.withColumns({"_q": query, "_a": answer, "_c": X.smart_truncate(F.col("context"), n.context)})
    total = F.length(sft_input(F.col("_q"), F.col("_c"))) + F.length("_a") + len(config.INSTRUCTION)
    first = first.withColumn("_room", F.greatest(F.lit(500), F.length("_c") - (total - n.total)))
    context = F.when(total > n.total, X.smart_truncate(F.col("context"), F.col("_room"))).otherwise(F.col("_c"))
    cut = (F.length("context") > n.context) | (F.length("answer") > n.answer)
    return first.withColumns({"instruction": F.lit(config.INSTRUCTION), "input": sft_input(F.col("_q"), context), "output": F.col("_a"), "truncated": cut}).drop("_q", "_a", "_c", "_room")


def sft_clean(rows: DataFrame, c: config.Cleaning = config.CLEANING) -> DataFrame:
    return rows.withColumns({"instruction": F.lit(config.INSTRUCTION), "input": sft_input(F.col("query"), X.safe_truncate(F.col("context"), c.max_context)), "output": F.col("answer")})


def upper_median(values: Column) -> Column:
    """The value at position n div 2 of the ordered values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def basic_stats(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row; the median is the upper one, from counts of distinct scores."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("total"), r6(F.avg(s)).alias("mean"), F.max(s).alias("most"), F.min(s).alias("least"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY coalesce({score}, 0.0) DESC)").alias("median"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in ("gold", "silver", "bronze", "rejected")], F.count_if("sft_ready").alias("sft_ready"),
    )


def failure_reasons(hit: Column, recall: Column, faithful: Column, complete: Column, hallucinated: Column, success: Column) -> Column:
    """All reasons that hold for a bad case; ``unknown`` alone where none does."""
    found = F.array_compact(
        F.array(
            F.when(hit == 0, "retrieval_failure").when(recall < 0.5, "retrieval_low_recall"),
            F.when(faithful < 0.5, "generation_hallucination"), F.when(complete < 0.4, "generation_incomplete"),
            F.when(hallucinated > 0, "hallucination_detected"), F.when(~success, "agentic_failure"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def layer_performance(rows: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, mean, least, most, n); zero scores do not count, layers without any are absent."""
    long_ = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("v")) for c in layers])).alias("x")).select("x.layer", "x.v")
    return long_.where("v <> 0").groupBy("layer").agg(r6(F.avg("v")).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))


def first_seen(key: str, order: str) -> Column:
    """Whether a row is not the first with its key."""
    return F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1
