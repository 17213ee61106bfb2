"""Aggregations: manifest, coverage, estimates, status roll-ups and page roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values
FINE = ("SUCCESS", "PARTIAL_ITEM")
META_KEYS = ("schema_version", "last_fetched_at_ms", "last_processed_at_ms")


def manifest_summary(payloads: DataFrame, results: DataFrame, errors: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per account with its counts and sums (0 where there is nothing) and its meta texts."""
    status = lambda s: F.count_if(F.col("status") == s)
    parts = [
        payloads.groupBy("uid").agg(F.countDistinct("endpoint").alias("endpoint_count"), F.count("*").alias("raw_payload_count"), F.count_if(F.col("endpoint") == "video_detail").alias("video_count")),
        results.groupBy("uid").agg(status("success").alias("transcribed_count"), status("failed").alias("transcription_failed_count"), F.sum("audio_tokens").alias("total_audio_tokens"), F.sum("seconds").alias("total_audio_seconds"), F.sum("cache_hits").alias("total_cache_hits")),
        errors.groupBy("uid").agg(F.count_if(F.col("stage") == "fetching").alias("fetching_error_count"), F.count_if(F.col("stage") == "asr").alias("asr_error_count")),
    ]
    texts = meta.groupBy("uid").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in META_KEYS))
    joined = reduce(lambda a, b: a.join(b, "uid", "full"), [texts, *parts])
    return joined.select("uid", *META_KEYS, *(F.coalesce(c, F.lit(0)).alias(c) for p in parts for c in p.columns if c != "uid"))


def endpoint_counts(payloads: DataFrame) -> DataFrame:
    return payloads.groupBy("endpoint").agg(F.count("*").alias("n"))


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "status").agg(F.count("*").alias("n"))


def coverage_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts per state, whether all is done, and the sorted ids that are missing or failed.

    ``rows`` has item_id and state (success, failed, missing or any other status).
    The id lists are as long as what is missing or failed in one group.
    """
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("item_id"))))
    return rows.groupBy(*by).agg(
        F.count("*").alias("expected"), n("success").alias("success"), n("missing").alias("missing"), n("failed").alias("failed"),
        n("pending").alias("pending"), n("running").alias("running"), n("skipped").alias("skipped"),
        (n("success") == F.count("*")).alias("complete"), ids("missing").alias("missing_ids"), ids("failed").alias("failed_ids"),
    )


def estimate_work(pages: DataFrame, by: list[str], rate: float = 6.5) -> DataFrame:
    """items, pages, seconds (bad durations are 0) and tokens = ceil(seconds * rate)."""
    seconds = F.sum(F.coalesce(F.col("duration_s").cast("string").try_cast("double"), F.lit(0.0)))
    out = pages.groupBy(*by).agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("pages"), seconds.alias("seconds"))
    return out.withColumn("tokens", F.ceil(F.col("seconds") * rate))


def exceeds_budget(max_seconds: float | None, max_tokens: int | None) -> Column:
    """Labels of the limits that ``seconds`` and ``tokens`` exceed."""
    over = lambda name, most: F.when(F.col(name) > most, name) if most is not None else F.lit(None).cast("string")
    return F.array_compact(F.array(over("seconds", max_seconds), over("tokens", max_tokens)))


def derive_task_status(states: DataFrame, by: list[str]) -> DataFrame:
    """Task status from endpoint statuses; a group without endpoints is PENDING."""
    s = F.col("status")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    partly = lambda failed: F.when(some(s.isin(*FINE)), "PARTIAL").otherwise(failed)
    status = (
        F.when(F.count(s) == 0, "PENDING").when(F.bool_and(s.isin(*FINE)), "SUCCESS")
        .when(some(s == "FAILED_PERMANENT"), partly("FAILED_PERMANENT")).when(some(s == "FAILED_EXHAUSTED"), partly("FAILED_EXHAUSTED"))
        .when(some(s == "FAILED_RETRYABLE"), "FAILED_RETRYABLE").otherwise("PARTIAL")
    )
    return states.groupBy(*by).agg(status.alias("task_status"))


def pipeline_rollup(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Sums of total, completed, failed and skipped over buckets (rows), and the status: each bucket is asked for an open rest."""
    columns = ("total", "completed", "failed", "skipped")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in columns}
    some = lambda c: F.bool_or(c)
    failed, done = some(n["failed"] > 0), some((n["completed"] > 0) | (n["skipped"] > 0))
    status = (
        F.when(some(n["total"] - n["completed"] - n["failed"] - n["skipped"] > 0), "RUNNING")
        .when(failed & done, "PARTIAL").when(failed, "FAILED_PERMANENT").otherwise("SUCCESS")
    )
    return outcomes.groupBy(*by).agg(*(F.sum(n[c]).alias(c) for c in columns), status.alias("status"))


def derive_stage_status(pipelines: DataFrame, coverage: DataFrame, by: list[str]) -> DataFrame:
    """Stage status over pipelines, lowered to PARTIAL where coverage (``complete``) is not, and the run status.

    A pipeline status that is not known counts as PENDING; a group that only
    coverage has is without pipelines, which is SUCCESS.
    """
    s = F.when(F.col("status").isin("RUNNING", "SUCCESS", "PARTIAL", "FAILED_PERMANENT"), F.col("status")).otherwise("PENDING")
    stage = (
        F.when(F.bool_and(s == "SUCCESS"), "SUCCESS").when(F.bool_or(s == "RUNNING"), "RUNNING")
        .when(F.bool_or(s == "FAILED_PERMANENT") & ~F.bool_or(s == "SUCCESS"), "FAILED_PERMANENT").otherwise("PARTIAL")
    )
    rows = pipelines.groupBy(*by).agg(stage.alias("stage_status")).join(coverage.select(*by, "complete"), by, "full")
    found = F.coalesce("stage_status", F.lit("SUCCESS"))
    lowered = F.when((found == "SUCCESS") & ~F.coalesce("complete", F.lit(True)), "PARTIAL").otherwise(found)
    run = run_status(lowered)
    return rows.select(*by, lowered.alias("stage_status"), run.alias("run_status"))


def run_status(task_status: Column) -> Column:
    """Status of a run whose task ended with ``task_status``: failures of any kind are FAILED."""
    return F.when(task_status.isin("SUCCESS", "DRY_RUN", "PARTIAL", "RUNNING", "PENDING"), task_status).otherwise("FAILED")


def fanout_result(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Endpoint result of item outcomes (completed, failed, unavailable, forbidden)."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    done, failed = n("completed", "unavailable"), n("failed")
    status = F.when(F.coalesce(F.bool_or(F.col("outcome") == "forbidden"), F.lit(False)), "FAILED_PERMANENT").when((failed > 0) & (done > 0), "PARTIAL_ITEM").when(failed > 0, "FAILED_EXHAUSTED").otherwise("SUCCESS")
    return outcomes.groupBy(*by).agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), n("unavailable").alias("skipped_unavailable"), status.alias("status"))


def page_rollup(segments: DataFrame, by: list[str]) -> DataFrame:
    """Per page: hits, fresh ones, skips (one class each: empty, high risk, truncated), sums and texts in order."""
    kind = F.when(F.col("is_empty_skip") == 1, "empty").when(F.col("is_high_risk_skip") == 1, "high_risk").when(F.col("is_truncated_skip") == 1, "truncated")
    rows = segments.withColumn("skip", kind)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    skip = lambda k: n(F.col("skip") == k).alias(f"{k}_skips")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rows.groupBy(*by).agg(
        n(F.col("from_cache")).alias("cache_hits"), n(~F.col("from_cache")).alias("fresh"), skip("empty"), skip("high_risk"), skip("truncated"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"),
        F.coalesce(F.bool_or(F.col("seconds").isNotNull()), F.lit(False)).alias("has_duration"), texts.alias("texts"),
    )


def assemble_items(pages: DataFrame, by: list[str]) -> DataFrame:
    """Item result: duration, tokens and hits in sum, page texts joined by newlines, status.

    A page's duration is the listed one, else its segments' sum if any, else the stream's.
    """
    duration = F.coalesce("listed_s", F.when(F.col("has_duration"), F.col("seconds")), "stream_s", F.lit(0))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), lambda x: F.trim(x) != "")
    out = pages.groupBy(*by).agg(
        F.sum(duration).alias("duration_s"), F.sum("tokens").alias("tokens"), F.sum("cache_hits").alias("cache_hits"),
        F.concat_ws("\n", texts).alias("joined"), F.bool_and(blank).alias("blank"),
    )
    return out.select(*by, "duration_s", F.floor("duration_s").cast("bigint").alias("cost_seconds"), "tokens", "cache_hits", F.when(F.col("joined") != "", F.col("joined")).alias("transcript"), F.when(F.col("blank"), "failed").otherwise("success").alias("status"))
