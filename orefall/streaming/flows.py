"""Structured Streaming: dedupe, bounded queue, trace roll-up and breaker over event files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orefall.operators.state import breaker_walk
from orefall.sources.files import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream; ts as a timestamp, which watermarks need.

    A stream reads folders, so a single file is named by its folder and a filter on names.
    """
    folder, _, name = path.rpartition("/")
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.col("event_type").alias("step"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def drained(stream: DataFrame, label: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there, into a table among the shared folders; checkpointed, so a restart resumes.

    ``each`` changes a micro-batch before it is written. In complete mode a batch replaces
    the table; a batch that is run again replaces its own rows.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, label), scratch(spark, f"{label}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        rows = each(batch, number) if each else batch
        rows.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def dedupe(stream: DataFrame, keys: list[str], delay: str = "60 days") -> DataFrame:
    """The keys, each once: state is dropped when the watermark passes."""
    return drained(stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys), "stream-dedupe")


def bounded_queue(stream: DataFrame, cap: int = 10) -> DataFrame:
    """(event_id, accepted): of each hour the first ``cap`` to come are taken, the others dropped; how many were taken is state, so an hour may span micro-batches."""

    def admit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else 0
        ids = pd.concat(list(parts))["event_id"].sort_values()
        accepted = [taken + i < cap for i in range(len(ids))]
        state.update((min(cap, taken + len(ids)),))
        yield pd.DataFrame({"event_id": ids.to_numpy(), "accepted": accepted})

    hours = stream.select("event_id", F.date_trunc("hour", "ts").alias("hour"))
    got = hours.groupBy("hour").applyInPandasWithState(admit, "event_id long, accepted boolean", "taken int", "append", GroupStateTimeout.NoTimeout)
    return drained(got, "stream-queue")


def rollup(stream: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window start, step, n, total) in event time."""
    agg = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "step").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    return drained(agg.select(F.col("w.start").alias("start"), "step", "n", "total"), "stream-rollup", "complete")


def breaker(stream: DataFrame, threshold: int = 5, open_seconds: float = 120.0) -> DataFrame:
    """(session, event_id): events that open a session's breaker; state is the failures in a row and the end of the open window.

    An event within the window is turned away and changes nothing; its end, or a success, forgets the failures.
    """

    def opened(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, until = state.get if state.exists else (0, None)
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
        found, (run, until) = breaker_walk((rows["step"] == "error").tolist(), rows["at"].tolist(), (run, until), threshold, open_seconds)
        hits = [e for e, (allowed, n) in zip(rows["event_id"], found, strict=True) if allowed and n >= threshold]
        state.update((run, until))
        yield pd.DataFrame({"session": [key[0]] * len(hits), "event_id": hits}).astype("int64")

    timed = stream.select("session", "event_id", "step", (F.unix_micros("ts") / 1_000_000).alias("at"))
    got = timed.groupBy("session").applyInPandasWithState(opened, "session long, event_id long", "run int, until double", "append", GroupStateTimeout.NoTimeout)
    return drained(got, "stream-breaker")
