"""Joins of items with results, errors, runs, caches and endpoint states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import norm_ns

KEYS = ["uid", "item_id"]


def items_with_results(items: DataFrame, results: DataFrame) -> DataFrame:
    return items.join(results, KEYS, "left")


def pending_items(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items without a result or with a failed one."""
    return items.join(results.select(*KEYS, "status"), KEYS, "left").where("status is null or status = 'failed'")


def failed_items(errors: DataFrame, completed: DataFrame) -> DataFrame:
    """Distinct items of errors that have not succeeded since."""
    return errors.where("item_id is not null").select(*KEYS).distinct().join(completed, KEYS, "left_anti")


def unavailable_items(errors: DataFrame, completed: DataFrame) -> DataFrame:
    return failed_items(errors.where("error_type = 'ResourceUnavailableError' and retryable = 0"), completed)


def events_with_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    return events.drop("uid").join(runs.select("run_id", "uid", "command"), "run_id")


def coverage_rows(expected: DataFrame, results: DataFrame) -> DataFrame:
    """State of each expected key: missing, failed, success or incomplete, with the status found."""
    joined = expected.select(*KEYS).join(results.select(*KEYS, "status"), KEYS, "left")
    state = F.when(F.col("status").isNull(), "missing").when(F.col("status").isin("failed", "success"), F.col("status")).otherwise("incomplete")
    return joined.withColumn("state", state)


def plan_fanout(listed: DataFrame, filtered: DataFrame, completed: DataFrame, unavailable: DataFrame, mode: str, now_ms: int = 0, days: int = 7) -> DataFrame:
    """``listed`` (uid, item_id, repeats kept) plus ``plan``: the first class that fits.

    ``completed`` has fetched_at_ms; modes are incremental, refresh and full.
    """
    mark = lambda df, name: df.select(*KEYS, F.lit(True).alias(name)).distinct()
    ages = completed.groupBy(*KEYS).agg(F.max("fetched_at_ms").alias("fetched_at_ms"))
    rows = listed.join(mark(filtered, "is_filtered"), KEYS, "left").join(mark(unavailable, "is_unavailable"), KEYS, "left").join(ages, KEYS, "left")
    known, stale = F.col("fetched_at_ms").isNotNull(), F.lit(now_ms) - F.col("fetched_at_ms") >= days * 86_400_000
    plan = F.when(F.col("is_filtered"), "skipped_filtered")
    if mode != "full":
        plan = plan.when(F.col("is_unavailable"), "skipped_unavailable")
        plan = plan.when(known, "skipped_existing") if mode == "incremental" else plan.when(known & ~stale, "skipped_fresh")
    return rows.withColumn("plan", plan.otherwise("fetch")).drop("is_filtered", "is_unavailable", "fetched_at_ms")


def cache_lookup(wanted: DataFrame, cached: DataFrame, keys: list[str], names: list[str], tol: float = 0.1) -> DataFrame:
    """Each wanted row (id, start_s, end_s) with the id of the first cached row that fits, by (start, end).

    Both ends differ by at most ``tol`` and the name-space columns agree after
    trim and lower. Starts are put in buckets of twice the tolerance and each
    wanted row looks in its own and both neighbours, so the join is on equality.
    """
    bucket = F.floor(F.col("start_s") / (2 * tol))
    spaces = [norm_ns(F.col(c)).alias(f"ns_{c}") for c in names]
    want = wanted.select(*keys, *spaces, F.col("id").alias("wanted_id"), F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    have = cached.select(*keys, *spaces, F.col("id").alias("cached_id"), "start_s", "end_s", bucket.alias("bucket"))
    on = [*keys, *(f"ns_{c}" for c in names), "bucket"]
    hits = want.join(have, on).where((F.abs(F.col("w_start") - F.col("start_s")) <= tol) & (F.abs(F.col("w_end") - F.col("end_s")) <= tol))
    return hits.groupBy(*keys, "wanted_id").agg(F.min(F.struct("start_s", "end_s", "cached_id")).alias("first")).select(*keys, "wanted_id", F.col("first.cached_id").alias("cached_id"))


def resolve_dependencies(requested: DataFrame, registry: DataFrame, states: DataFrame) -> DataFrame:
    """For each requested endpoint of an account its source, whether that is pulled in, and the verdict.

    ``requested`` and ``states`` have uid and endpoint; ``registry`` name and source_endpoint.
    """
    sources = registry.select(F.col("name").alias("endpoint"), F.col("source_endpoint").alias("source"))
    rows = requested.select("uid", "endpoint").join(sources, "endpoint", "left")
    asked = requested.select("uid", F.col("endpoint").alias("source"), F.lit(True).alias("is_asked"))
    status = states.select("uid", F.col("endpoint").alias("source"), F.col("status").alias("source_status"))
    rows = rows.join(asked, ["uid", "source"], "left").join(status, ["uid", "source"], "left")
    verdict = F.when(F.col("source").isNull(), "independent").when(F.col("source_status") == "SUCCESS", "ready").otherwise("FAILED_PERMANENT")
    pulled = F.col("source").isNotNull() & F.col("is_asked").isNull() & F.col("source_status").isNull()
    return rows.select("uid", "endpoint", "source", pulled.alias("pull_in"), verdict.alias("verdict"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order."""
    return rows.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")
