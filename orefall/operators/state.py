"""State folded from append-only rows: artifacts, traces, memory, dedupe, eviction, queues, breakers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: Column | str, *values: str) -> DataFrame:
    """The values of the last row of each key (last write wins), by a partial aggregate rather than a window."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def fold_runs(events: DataFrame) -> DataFrame:
    """A run a session: first start, last status and name, and what the events said, the later winning."""
    return events.groupBy("session").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.max_by("step", "event_id").alias("status"),
        F.max_by("k", "event_id").alias("last_k"), F.count("*").alias("n_events"),
    )


def run_status(metadata: Column) -> Column:
    """An explicit known status; failed for an unfinished stream, an error or an exception; else completed."""
    said = F.lower(F.trim(F.get_json_object(metadata, "$.status")))
    truthy = lambda f: ~F.coalesce(F.get_json_object(metadata, f"$.{f}"), F.lit("")).isin("", "false", "0", "null", "[]", "{}")
    return (
        F.when(said.isin("running", "completed", "failed", "cancelled"), said)
        .when(F.get_json_object(metadata, "$.stream_completed") == "false", "failed")
        .when(truthy("error") | truthy("exception"), "failed")
        .otherwise("completed")
    )


def step_status(name: Column, data: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    bad = ~F.coalesce(F.get_json_object(data, "$.error"), F.lit("")).isin("", "false", "0", "null") | F.coalesce(F.get_json_object(data, "$.success") == "false", F.lit(False))
    return F.when(low.contains("error") | low.contains("failed") | bad, "error").when(low.contains("finish") | low.contains("completed") | low.contains("done"), "completed").otherwise("info")


def event_step_status(kind: Column) -> Column:
    return F.when(kind == "error", "error").when(kind.isin("finish", "complete", "completed"), "completed").otherwise("info")


def memory_window(messages: DataFrame, turns: int = 10) -> DataFrame:
    """The last 2 * turns messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= 2 * turns)


def to_summarise(messages: DataFrame, turns: int, up_to: Column) -> DataFrame:
    """Messages from the marker to 2 * turns before the end."""
    w = Window.partitionBy("conv_id")
    counted = messages.withColumn("n", F.count("*").over(w)).withColumn("seq", F.row_number().over(w.orderBy("turn")) - 1)
    return counted.where((F.col("seq") >= up_to) & (F.col("seq") < F.col("n") - 2 * turns))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the first by order; aggregated map-side."""
    others = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("r"))
    return packed.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def ordinals(rows: DataFrame, order: str, name: str = "ordinal", block: int = 65536) -> DataFrame:
    """Ordinals 0, 1, … over the whole table without gathering it in one task.

    Counts of value blocks are summed in order (one row a block), then rows are numbered
    within their block. ``order`` is a whole number column without duplicates.
    """
    blocked = rows.withColumn("_b", F.floor(F.col(order) / block))
    before = blocked.groupBy("_b").agg(F.count("*").alias("_n"))
    before = before.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return blocked.withColumn("_i", within).join(before, "_b").withColumn(name, F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def traced(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """Rows with the trace_id that is open for their key: each start opens the next; rows before the first are left out."""
    run = F.count_if(starts).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_run", run).where("_run > 0").withColumn("trace_id", F.concat_ws(":", F.col(key).cast("string"), F.col("_run").cast("string"))).drop("_run")


def fifo_kept(keys: DataFrame, order: str, most: int = 1000, keep: int = 500) -> DataFrame:
    """What is left of keys that came in order, when more than ``most`` are cut to the newest ``keep`` each time."""
    numbered = ordinals(keys, order, "n").crossJoin(F.broadcast(keys.agg(F.count("*").alias("total"))))
    # After the first cut at most + 1 keys, each further (most + 1 - keep) keys cause another.
    step = most + 1 - keep
    last_cut = F.when(F.col("total") <= most, 0).otherwise(most + 1 + F.floor((F.col("total") - most - 1) / step) * step)
    return numbered.where(F.col("n") >= F.when(last_cut > 0, last_cut - keep).otherwise(0)).drop("n", "total")


def lru_kept(rows: DataFrame, key: str, used: str, most: int = 100) -> DataFrame:
    """The ``most`` keys used last."""
    return rows.groupBy(key).agg(F.max(used).alias("last_used")).orderBy(F.desc("last_used"), key).limit(most)


def admitted(rows: DataFrame, batch: str, order: str, cap: int) -> DataFrame:
    """accepted: the first ``cap`` rows of each batch; the others are dropped on a full queue."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(batch).orderBy(order))).withColumn("accepted", F.col("position") <= cap)


def sampled(key: Column, rate: float) -> Column:
    """A fixed share of keys by hash: the same keys each time."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000)


def breaker_islands(rows: DataFrame, key: str, order: str, failed: Column, threshold: int = 5) -> DataFrame:
    """Runs of consecutive failures that are long enough to open the breaker: (key, first, last, n)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_f", failed.cast("int")).withColumn("_g", F.sum(F.lit(1) - F.col("_f")).over(w))
    runs = marked.where("_f = 1").groupBy(key, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= threshold).drop("_g")


def breaker_walk(failed: Sequence[bool], at: Sequence[float], state: tuple[int, float | None], threshold: int, open_seconds: float) -> tuple[list[tuple[bool, int]], tuple[int, float | None]]:
    """((allowed, failures in a row after it) of each event in order, state after them); state is (failures in a row, open until).

    An event within the open window is turned away and changes nothing. The window's end
    forgets all failures, a success does too, and the ``threshold``-th failure opens it.
    """
    run, until = state
    out = []
    for bad, now in zip(failed, at, strict=True):
        if until is not None and now < until:
            out.append((False, run))
            continue
        run, until = (0 if until is not None else run), None
        run = run + 1 if bad else 0
        until = now + open_seconds if run >= threshold else None
        out.append((True, run))
    return out, (run, until)


def breaker(rows: DataFrame, key: str, ts: str, order: str, failed: str, threshold: int = 5, open_seconds: float = 120.0) -> DataFrame:
    """(key, order, allowed, failures): a circuit breaker for each key; events pass sorted through tasks that hold a key's state alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, (0, None)
        for b in batches:
            out: list[tuple[bool, int]] = []
            starts = [0, *np.flatnonzero((b["k"].to_numpy()[1:] != b["k"].to_numpy()[:-1])) + 1, len(b)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if lo == hi:
                    continue
                part = b.iloc[lo:hi]
                held, state = (held, state) if held == (part["k"].iloc[0],) else ((part["k"].iloc[0],), (0, None))
                found, state = breaker_walk(part["bad"].tolist(), part["at"].tolist(), state, threshold, open_seconds)
                out += found
            yield pd.DataFrame({"k": b["k"], "o": b["o"], "allowed": [a for a, _ in out], "failures": [f for _, f in out]})

    kinds = dict(rows.dtypes)
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    asked = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(failed), F.lit(False)).alias("bad"), at.alias("at")).where("k IS NOT NULL AND at IS NOT NULL")
    sorted_rows = asked.repartition("k").sortWithinPartitions("k", "at", "o")
    out = sorted_rows.mapInPandas(run, f"k {kinds[key]}, o {kinds[order]}, allowed boolean, failures int")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "allowed", "failures")
