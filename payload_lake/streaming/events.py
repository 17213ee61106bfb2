"""Structured Streaming over the event log and the state tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_attention
from ..operators.runs import STALE_MS
from ..sources.tables import BROKEN


def ingest_events(events: DataFrame, path: str, checkpoint: str):
    """Append events to a Parquet table; returns the started query."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_progress(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Running item counts of each run, endpoint and day (``day_start``): the watermark ends a day and frees its state.

    ``events`` has run_id, endpoint, event and ts; an event ends an item as
    completed (``.saved`` or ``.completed``), failed or skipped, or does not.
    """
    n = lambda alias, *names: F.count_if(reduce(lambda a, b: a | b, [F.col("event").ilike(f"%.{x}") for x in names])).alias(alias)
    counts = n("completed", "saved", "completed"), n("failed", "failed"), n("skipped", "skipped")
    rows = events.withWatermark("ts", watermark).groupBy("run_id", "endpoint", F.window("ts", "1 day")).agg(F.count("*").alias("total"), *counts)
    return rows.withColumn("day_start", F.col("window.start")).drop("window")


def stream_attention(events: DataFrame) -> DataFrame:
    return events.where(is_attention(F.col("level"), F.col("event")))


def write_events(events: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str):
    """Hand each micro-batch to several sinks in order, read once."""

    def fan_out(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, number)
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_stale_runs(events: DataFrame, threshold_ms: int = STALE_MS, watermark: str = "0 seconds") -> DataFrame:
    """One alert for each silence of a run of the threshold or longer, by event time, once the watermark has passed it.

    Events of a run less than the threshold apart are one session; a session in which
    the run ends gives no alert, and a run that goes on after a pause may give more than one.
    """
    ended = F.coalesce(F.col("event").endswith("run.completed"), F.lit(False))
    # a window joins events that are the gap apart, so the gap is one microsecond less
    session = F.session_window("ts", f"{threshold_ms * 1000 - 1} microseconds")
    sessions = events.withWatermark("ts", watermark).groupBy("run_id", session).agg(F.max("ts").alias("last"), F.max(ended).alias("ended"))
    return sessions.where("not ended").select("run_id", F.unix_millis("last").alias("last_ts_ms"))


def stream_runs(log: DataFrame, within: str = "2 days", watermark: str = "2 days") -> DataFrame:
    """Runs of a streamed run log: each start with the end that comes within ``within``, in either order of arrival.

    A start whose end has not come when the watermark has passed its time gives a row
    without an end, and an end without its start a row without a start, so the state of
    the join is bounded by the open runs.
    """
    timed = log.withColumn("ts", F.timestamp_millis("ts_ms"))
    started = timed.where("type = 'run.started'").withWatermark("ts", watermark).select("run_id", "uid", "command", F.col("ts").alias("started_at"))
    ended = timed.where("type = 'run.completed'").withWatermark("ts", watermark).select(F.col("run_id").alias("ended_run_id"), "status", "summary", F.col("ts").alias("ended_at"))
    same = F.expr(f"run_id = ended_run_id and ended_at >= started_at and ended_at <= started_at + interval {within}")
    return started.join(ended, same, "full_outer").select(
        F.coalesce("run_id", "ended_run_id").alias("run_id"), "uid", "command", F.unix_millis("started_at").alias("started_at_ms"), "status", F.unix_millis("ended_at").alias("ended_at_ms"), "summary",
    )


def split_event_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a streamed log read with ``broken``: lines that are no JSON, have no known type, or are events without run, id or time are rejects, as text."""
    whole = F.col(BROKEN).isNull() & F.coalesce(F.col("type").isin("run.started", "event", "run.completed"), F.lit(False))
    is_event = F.col("type") == "event"
    complete = ~is_event | (F.col("run_id").isNotNull() & F.col("id").isNotNull() & F.col("ts_ms").isNotNull())
    columns = [c for c in log.columns if c != BROKEN]
    line = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*columns))).alias("line")
    return log.where(whole & complete & is_event).select(*columns), log.where(~(whole & complete)).select(line)


def ingest_event_log(log: DataFrame, root: str, checkpoint: str, watermark: str = "1 day") -> list:
    """Append the events of a streamed log to ``root/events`` and its rejects to ``root/rejects``; returns the started queries.

    A line that comes again (the same run and id) within the watermark is taken once:
    a writer that was cut off repeats its last lines.
    """
    events, rejects = split_event_log(log)
    once = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["run_id", "id"])
    return [ingest_events(once, f"{root}/events", f"{checkpoint}/events"), ingest_events(rejects, f"{root}/rejects", f"{checkpoint}/rejects")]
