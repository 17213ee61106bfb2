"""Run history: latest runs, recent events, guards, resume plans and the attempt ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsonx
from .joins import latest_per_key
from .selects import attention_events

#: fixed value: a run without an update for so long may be taken over
STALE_MS = 15 * 60 * 1000


def latest_run(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """The newest run of each account (start, then insertion order), or a named run."""
    if run_id is not None:
        return runs.where(F.col("run_id") == run_id)
    return latest_per_key(runs, ["uid"], [F.desc("started_at"), F.desc("seq")])


def recent_events(events: DataFrame, n: int | None, by: list[str] | None = None) -> DataFrame:
    """The last n events by id, of each group of ``by`` or of all; none if n is not positive, every one if it is None.

    Spark keeps n rows of a group in each task before it shuffles, so a hot group sends little.
    """
    if n is None:
        return events
    if n <= 0:
        return events.limit(0)
    if not by:
        return events.orderBy(F.desc("id")).limit(n)
    return events.withColumn("__place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("id")))).where(F.col("__place") <= n).drop("__place")


def recent_attention(events: DataFrame, n: int | None, by: list[str] | None = None) -> DataFrame:
    return recent_events(attention_events(events), n, by)


def candidate_count(events: DataFrame, by: list[str], key: str = "candidate_count") -> DataFrame:
    """The count in the last discovery event of each group."""
    found = events.where("event = 'asr.discovery.completed'").withColumn("count", F.get_json_object("data_json", f"$.{key}").try_cast("bigint"))
    return found.groupBy(*by).agg(F.max_by("count", "id").alias("candidate_count"))


def attempt_ledger(attempts: DataFrame, by: list[str], max_attempts: int, delays: list[float]) -> DataFrame:
    """``attempts`` (seq, ok, retryable, advised_s) with number, will_retry, next_delay_s and the item's outcome.

    The last delay repeats; an advised wait can only raise it.
    """
    own = W.partitionBy(*by)
    waits = F.array(*(F.lit(float(d)) for d in delays))
    number = F.row_number().over(own.orderBy("seq"))
    rows = attempts.withColumn("number", number).withColumn("will_retry", ~F.col("ok") & F.col("retryable") & (F.col("number") < max_attempts))
    wait = F.greatest(F.element_at(waits, F.least(F.col("number"), F.lit(len(delays))).cast("int")), F.coalesce(F.col("advised_s").cast("double"), F.lit(0.0)))
    last_ok, last_retryable = (F.max_by(c, "seq").over(own) for c in ("ok", "retryable"))
    outcome = F.when(last_ok, "success").when(~last_retryable, "permanent").otherwise("exhausted")
    return rows.withColumn("next_delay_s", F.when(F.col("will_retry"), wait)).withColumn("outcome", outcome)


def run_guard(tasks: DataFrame, now_ms: int, threshold_ms: int = STALE_MS) -> DataFrame:
    """``tasks`` (uid, stage, status, updated_at_ms) with guard: blocked, takeover or free.

    A running task younger than the threshold blocks; an older one, or one
    without a time, is taken over as PARTIAL.
    """
    old = F.col("updated_at_ms").isNull() | (F.lit(now_ms) - F.col("updated_at_ms") >= threshold_ms)
    guard = F.when(F.col("status") != "RUNNING", "free").when(old, "takeover").otherwise("blocked")
    return tasks.withColumn("guard", guard).withColumn("effective_status", F.when(guard == "takeover", "PARTIAL").otherwise(F.col("status")))


def active_stages(guarded: DataFrame) -> DataFrame:
    """Stages that block, listed per account."""
    return guarded.where("guard = 'blocked'").groupBy("uid").agg(F.array_sort(F.collect_set("stage")).alias("active_stages"))


def resume_plan(tasks: DataFrame, mode: str, now_ms: int, threshold_ms: int = STALE_MS) -> DataFrame:
    """``tasks`` with decision: new, blocked, stop, rescan or resume."""
    rows = run_guard(tasks, now_ms, threshold_ms)
    status = F.col("effective_status")
    rescan = F.lit("rescan" if mode in ("incremental", "refresh") else "new" if mode == "full" else "resume")
    decision = (
        F.when(F.col("status").isNull(), "new").when(F.col("guard") == "blocked", "blocked").when(status == "FAILED_PERMANENT", "stop")
        .when(status == "SUCCESS", rescan).when(F.lit(mode == "full"), "new").otherwise("resume")
    )
    return rows.withColumn("decision", decision)


def endpoint_reset(wanted: DataFrame, states: DataFrame, mode: str, fresh: bool = False) -> DataFrame:
    """Status and retry count with which each wanted endpoint (uid, endpoint) starts."""
    rows = wanted.join(states.select("uid", "endpoint", "status", "retry_count"), ["uid", "endpoint"], "left")
    anew = F.lit(fresh) | F.col("status").isNull() | (F.col("status") == "FAILED_EXHAUSTED")
    again = (F.col("status") == "SUCCESS") & F.lit(mode in ("incremental", "refresh"))
    return rows.select("uid", "endpoint", F.when(anew | again, "PENDING").otherwise(F.col("status")).alias("status"), F.when(anew, 0).otherwise(F.col("retry_count")).alias("retry_count"))


def coverage_applies(command: Column, args_json: Column, summary_json: Column) -> Column:
    """Whether coverage of all items says something about a run: not about a partial recogniser run or one that ran out of its budget."""
    args, summary = jsonx.parsed(args_json), jsonx.parsed(summary_json)
    given = lambda key: F.coalesce(jsonx.kind(jsonx.at(args, key)) != "null", F.lit(False))
    set_to = lambda key: jsonx.truthy(jsonx.at(args, key))
    partial = set_to("dry_run") | given("limit") | given("only_bvids") | given("exclude_bvids") | set_to("retry_failed_only")
    return F.coalesce(command != "asr", F.lit(True)) | ~(partial | jsonx.truthy(jsonx.at(summary, "budget_exceeded")))


def run_summary(
    runs: DataFrame, events: DataFrame, tasks: DataFrame, states: DataFrame, coverage: DataFrame, n: int | None = 5, uid: int | None = None, run_id: str | None = None, only_run: bool = True, count_key: str = "candidate_count",
) -> DataFrame:
    """One row per account, also for those without a run: the chosen run, tasks, endpoint states, coverage, candidates and events.

    The run is the newest of the account or the named one; events and candidates
    are those of the run, or of all runs of the account unless ``only_run``.
    ``runs`` has run_id, uid, command, status, started_at, seq, args_json and
    summary_json; ``tasks`` uid, stage and status; ``states`` uid, endpoint and
    status; ``coverage`` uid, expected, success and complete.
    """
    if uid is not None:
        runs, tasks, states, coverage = (df.where(F.col("uid") == uid) for df in (runs, tasks, states, coverage))
    chosen = latest_run(runs, run_id).select("uid", "run_id", "command", F.col("status").alias("run_status"), coverage_applies(F.col("command"), F.col("args_json"), F.col("summary_json")).alias("coverage_applicable"))
    known = [df.select("uid") for df in ((chosen,) if run_id is not None else (runs, tasks, states, coverage))]
    out = reduce(DataFrame.unionByName, known).distinct().join(chosen, "uid", "left")
    own = events.drop("uid").join((chosen if only_run else runs).select("uid", "run_id"), "run_id")
    listed = lambda df, name: df.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("id", "level", "event"))).alias(name))
    statuses = lambda df, key, name: df.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct(key, "status"))).alias(name))
    counted = states.groupBy("uid").agg(F.count("*").alias("endpoints"), F.count_if(F.col("status") == "SUCCESS").alias("endpoints_done"))
    parts = (
        statuses(tasks, "stage", "tasks"), counted, coverage, candidate_count(own, ["uid"], count_key),
        listed(recent_events(own, n, ["uid"]), "recent_events"), listed(recent_attention(own, n, ["uid"]), "attention_events"),
    )
    for part in parts:
        out = out.join(part, "uid", "left")
    nothing = {name: F.coalesce(name, F.array().cast(out.schema[name].dataType)) for name in ("tasks", "recent_events", "attention_events")}
    return out.withColumns(nothing | {"coverage_applicable": F.coalesce("coverage_applicable", F.lit(True))})


#: columns of an event in a run report
EVENT_COLUMNS = ("id", "ts_ms", "level", "stage", "event", "endpoint", "item_id", "message", "data_json")
#: states of an item by its result; an item without one is missing
ITEM_STATES = ("success", "failed", "skipped", "pending", "running")


def item_states(expected: DataFrame, results: DataFrame) -> DataFrame:
    """uid, item_id and state of each expected item: the status of its result, or missing."""
    known = results.select("uid", "item_id", "status")
    return expected.select("uid", "item_id").distinct().join(known, ["uid", "item_id"], "left").select("uid", "item_id", F.coalesce("status", F.lit("missing")).alias("state"))


def open_items(expected: DataFrame, results: DataFrame) -> DataFrame:
    """The missing and failed items of each account, a row for each: an account may have any number."""
    return item_states(expected, results).where("state in ('missing', 'failed')")


def item_coverage(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Items of each account by state, and ``status_counts`` of all of its results, expected or not."""
    states = item_states(expected, results)
    counted = states.groupBy("uid").agg(F.count("*").alias("expected"), *(F.count_if(F.col("state") == x).alias(x) for x in (*ITEM_STATES, "missing")))
    each = results.groupBy("uid", "status").agg(F.count("*").alias("n"))
    by_status = each.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("status_counts"))
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("expected", *ITEM_STATES, "missing")}
    return counted.join(by_status, "uid", "full").withColumns(numbers)


def run_report(
    runs: DataFrame, events: DataFrame, tasks: DataFrame, states: DataFrame, expected: DataFrame, results: DataFrame, n: int | None = 20, uid: int | None = None, run_id: str | None = None, only_run: bool = True,
    count_key: str = "candidate_count",
) -> DataFrame:
    """One row per account with all that a run summary shows; missing and failed items by ``open_items``.

    ``run`` is the newest run of the account, or the named one, and null if there is none:
    an account is there also without a run, and ``uid`` is there whatever is stored.
    ``tasks`` and ``endpoints`` are lists by stage and by endpoint with their times, tries and
    progress; ``fetch_status`` is that of the fetching task, ``asr_status`` that of
    the audio pipeline in the recogniser task's payload. ``recent_events`` and
    ``attention_events`` are the last ``n`` of the run, oldest first, or of all runs
    of the account unless ``only_run``. Columns that an input lacks are null.
    """
    if uid is not None:
        tasks, states, expected, results = (df.where(F.col("uid") == uid) for df in (tasks, states, expected, results))
    known = runs if uid is None else runs.where(F.col("uid") == uid)
    if run_id is not None:
        found = runs.where(F.col("run_id") == run_id)
        chosen = found if uid is None else found.withColumn("uid", F.lit(uid).cast(runs.schema["uid"].dataType))
    else:
        chosen = latest_run(known)
    if uid is not None:
        accounts = runs.sparkSession.range(1).select(F.lit(uid).cast(runs.schema["uid"].dataType).alias("uid"))
    else:
        accounts = reduce(DataFrame.unionByName, [df.select("uid") for df in ((chosen,) if run_id is not None else (runs, tasks, states, expected, results))]).distinct()
    own_run = ("run_id", "command", "status", "started_at", "ended_at", "args_json", "summary_json")
    run = chosen.select("uid", F.struct(*_given(chosen, own_run)).alias("run"), coverage_applies(F.col("command"), F.col("args_json"), F.col("summary_json")).alias("applies"))
    listed = lambda df, columns, name: df.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(*_given(df, columns)))).alias(name))
    stage = lambda name: F.col("stage") == name
    payload = _given(tasks, ("payload",))[0]
    audio = jsonx.at(jsonx.parsed(payload.cast("string")), "pipelines.audio.status", "string")
    statuses = tasks.groupBy("uid").agg(F.max(F.when(stage("fetching"), F.col("status"))).alias("fetch_status"), F.max(F.when(stage("asr"), audio)).alias("asr_status"))
    own = events.drop("uid").join((chosen if only_run else known).select("uid", "run_id"), "run_id")
    parts = (
        run, listed(tasks, ("stage", "status", "created_at_ms", "updated_at_ms"), "tasks"), statuses,
        listed(states, ("endpoint", "status", "retry_count", "last_error_id", "item_progress", "progress", "updated_at_ms"), "endpoints"), item_coverage(expected, results), candidate_count(own, ["uid"], count_key),
        listed(recent_events(own, n, ["uid"]), EVENT_COLUMNS, "recent_events"), listed(recent_attention(own, n, ["uid"]), EVENT_COLUMNS, "attention_events"),
    )
    out = accounts
    for part in parts:
        out = out.join(part, "uid", "left")
    lists = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("tasks", "endpoints", "status_counts", "recent_events", "attention_events")}
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("expected", *ITEM_STATES, "missing")}
    return out.withColumns(lists | numbers | {"coverage_applicable": F.coalesce("applies", F.lit(True))}).drop("applies")


def _given(df: DataFrame, columns) -> list[Column]:
    """The columns by name; null where ``df`` lacks one."""
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]


def dashboard(manifest: DataFrame, latest: DataFrame, active: DataFrame, broken: DataFrame) -> DataFrame:
    """One row per account with its newest run (``latest``: uid, run_id, command); an account whose rows could not be read has ``read_error`` and no failure follows."""
    numbers = [c for c in manifest.columns if c.endswith("_at_ms")]
    typed = manifest.select(*(F.col(c).try_cast("bigint").alias(c) if c in numbers else F.col(c) for c in manifest.columns))
    rows = typed.join(broken.select("uid", F.col("reason").alias("read_error")), "uid", "full")
    rows = rows.join(latest.select("uid", "run_id", "command"), "uid", "left").join(active, "uid", "left")
    return rows.withColumn("active_stages", F.coalesce("active_stages", F.array().cast("array<string>")))


def recommend_actions(report: DataFrame, by: list[str]) -> DataFrame:
    """Next actions from a coverage report: retry what failed, then run what is missing."""
    action = lambda place, name, ids: F.when(F.size(ids) > 0, F.struct(F.lit(place).alias("place"), F.lit(name).alias("action"), F.col(ids).alias("ids")))
    some = F.array_compact(F.array(action(1, "retry_failed", "failed_ids"), action(2, "run_missing", "missing_ids")))
    return report.select(*by, F.explode(some).alias("a")).select(*by, "a.place", "a.action", F.size("a.ids").alias("n"), "a.ids")
