"""Declared rules of the tables: values, keys and schema versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: fixed values: rules by table, as name: SQL condition; null passes
RULES: dict[str, dict[str, str]] = {
    "raw_payload": {"fetched_at": "fetched_at_ms >= 0"},
    "fetch_progress": {"total": "total >= 0", "fetched": "fetched >= 0", "fetched_in_total": "fetched <= total", "updated_at": "updated_at_ms >= 0"},
    "audio_transcription": {"status": "status in ('pending', 'running', 'success', 'failed', 'skipped')", "tokens": "audio_tokens >= 0", "seconds": "seconds >= 0", "cache_hits": "cache_hits >= 0", "processed_at": "processed_at_ms >= 0"},
    "audio_transcription_page": {"page_no": "page_no >= 1", "page_index": "page_index >= 0", "cid": "cid >= 0", "duration": "duration_s >= 0", "chars": "transcript_char_count >= 0", "segments": "segment_count >= 0"},
    "audio_transcription_segment": {"segment_no": "segment_no >= 1", "start": "start_seconds >= 0", "end_after_start": "end_seconds >= start_seconds", "duration": "duration_s >= 0", "empty_flag": "is_empty_transcript_skip in (0, 1)", "risk_flag": "is_high_risk_audio_skip in (0, 1)"},
    "stage_task": {
        "stage": "stage in ('fetching', 'asr')", "status": "status in ('PENDING', 'RUNNING', 'SUCCESS', 'PARTIAL', 'FAILED', 'FAILED_RETRYABLE', 'FAILED_EXHAUSTED', 'FAILED_PERMANENT')",
        "created_at": "created_at_ms >= 0", "times": "updated_at_ms >= created_at_ms",
    },
    "fetch_endpoint_state": {"status": "status in ('PENDING', 'RUNNING', 'SUCCESS', 'PARTIAL_ITEM', 'FAILED_RETRYABLE', 'FAILED_EXHAUSTED', 'FAILED_PERMANENT')", "retry_count": "retry_count >= 0", "updated_at": "updated_at_ms >= 0"},
    "stage_error": {"stage": "stage in ('fetching', 'asr')", "retryable": "retryable in (0, 1)", "occurred_at": "occurred_at_ms >= 0"},
    "stage_run": {"status": "status in ('PENDING', 'RUNNING', 'SUCCESS', 'PARTIAL', 'FAILED', 'CANCELLED', 'DRY_RUN')", "started_at": "started_at_ms >= 0", "times": "ended_at_ms >= started_at_ms"},
    "stage_event": {"level": "level in ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL')", "ts": "ts_ms >= 0"},
}
#: fixed values: columns that must have a value
REQUIRED: dict[str, tuple[str, ...]] = {
    "meta": ("value",),
    "raw_payload": ("endpoint", "item_id", "payload", "fetched_at_ms"),
    "fetch_progress": ("updated_at_ms",),
    "audio_transcription": ("status", "payload", "processed_at_ms"),
    "audio_transcription_page": ("item_id", "page_no", "page_index", "transcript_text", "transcript_char_count", "segment_count"),
    "audio_transcription_segment": ("item_id", "page_no", "segment_no", "transcript_text", "is_empty_transcript_skip", "is_high_risk_audio_skip"),
    "stage_task": ("status", "payload", "created_at_ms", "updated_at_ms"),
    "fetch_endpoint_state": ("status", "retry_count", "updated_at_ms"),
    "stage_error": ("stage", "error_type", "message", "occurred_at_ms"),
    "stage_run": ("uid", "command", "status", "started_at_ms", "args_json"),
    "stage_event": ("run_id", "ts_ms", "level", "stage", "event"),
}


def table_rules(table: str) -> dict[str, str]:
    """All rules of a table: its conditions, and one for each column that must have a value."""
    return RULES.get(table, {}) | {f"{c}_given": f"`{c}` is not null" for c in REQUIRED[table]}


def check_rules(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule and number of violations, all rules in one pass; null passes as in a CHECK."""
    counts = rows.agg(*(F.count_if(_breaks(rule)).alias(name) for name, rule in rules.items()))
    return counts.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules)))).alias("rule", "violations"))


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The rows that break a rule, once for each rule that they break."""
    broken = F.array_compact(F.array(*(F.when(_breaks(rule), F.lit(name)) for name, rule in rules.items())))
    return rows.select("*", F.explode(broken).alias("rule"))


def write_checked(rows: DataFrame, path: str, table: str, mode: str = "errorifexists") -> DataFrame:
    """Write rows of a declared table and return rule and violations of all its rules, counted in the pass that writes.

    Rows that break a rule are written like the others; ``violations`` over the written
    table lists them.
    """
    rules, observed = table_rules(table), Observation()
    counted = rows.observe(observed, *(F.count_if(_breaks(rule)).alias(name) for name, rule in rules.items()))
    counted.write.mode(mode).parquet(path)
    counts = observed.get
    return rows.sparkSession.createDataFrame([(name, int(counts.get(name) or 0)) for name in rules], "rule string, violations long")


def _breaks(rule: str) -> Column:
    """Whether a row breaks a rule; null passes as in a CHECK."""
    return ~F.coalesce(F.expr(rule), F.lit(True))


def check_primary_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on more than one row, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_foreign_key(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose key the parent lacks."""
    return child.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).join(parent.select(*keys), keys, "left_anti")


def check_version(meta: DataFrame, version: str) -> DataFrame:
    """Accounts whose schema version is missing or another one."""
    found = meta.groupBy("uid").agg(F.max(F.when(F.col("key") == "schema_version", F.col("value"))).alias("schema_version"))
    return found.where(~F.col("schema_version").eqNullSafe(F.lit(version)))
