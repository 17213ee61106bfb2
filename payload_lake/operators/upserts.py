"""Upserts, merges and purges of snapshot tables, as DataFrames from base and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.scalars import safe_double
from .numbering import numbered


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last write wins by ``seq``, whatever the rows' own times say. ``base`` may lack ``seq``."""
    if seq not in base.columns:
        base = base.withColumn(seq, F.lit(None).cast(changes.schema[seq].dataType))
    rest = [c for c in changes.columns if c not in keys]
    last = base.unionByName(changes).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(seq), F.lit(-1))).alias("last"))
    return last.select(*keys, "last.*")


def upsert_progress(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Paging progress by uid and endpoint; a cursor that is no text is stored as JSON text."""
    if changes.schema["cursor"].dataType.typeName() != "string":
        changes = changes.withColumn("cursor", F.to_json("cursor"))
    return upsert(base, changes, ["uid", "endpoint"])


def merge_coalesce(changes: DataFrame, keys: list[str], always: list[str], when_given: list[str], seq: str = "seq") -> DataFrame:
    """Per key the last of the ``always`` columns, and of each ``when_given`` column the last that is not null."""
    last = [F.max_by(c, seq).alias(c) for c in always]
    given = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in when_given]
    return changes.groupBy(*keys).agg(*last, *given)


def seed_missing(base: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` plus the wanted keys that it lacks; existing rows keep their state."""
    return base.unionByName(wanted.join(base, keys, "left_anti"), allowMissingColumns=True)


def append_with_ids(log: DataFrame, rows: DataFrame, order_by: list[str], by: str = "uid") -> DataFrame:
    """``rows`` with ids that go on, per account, from the largest in the log; an account of any size is numbered by many tasks."""
    top = log.groupBy(by).agg(F.max("id").alias("__top"))
    return numbered(rows.drop("id"), [by], order_by, "__place").join(top, by, "left").withColumn("id", F.coalesce("__top", F.lit(0)) + F.col("__place")).drop("__top", "__place")


def apply_run_updates(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Runs with status, end and summary from their first completion (least ``seq``); others stay as they are."""
    first = updates.groupBy("run_id").agg(F.min_by(F.struct(F.col("status").alias("u_status"), F.col("ended_at").alias("u_ended"), F.col("summary").alias("u_summary")), "seq").alias("u"))
    joined = runs.join(first, "run_id", "left")
    return joined.select(*(c for c in runs.columns if c not in ("status", "ended_at", "summary")), F.coalesce("u.u_status", "status").alias("status"), F.coalesce("u.u_ended", "ended_at").alias("ended_at"), F.coalesce("u.u_summary", "summary").alias("summary"))


PAGE_COLUMNS = ("uid", "item_id", "page_no", "page_index", "cid", "duration_s", "language", "asr_model", "transcript_text", "transcript_char_count", "segment_count")


def explode_pages(results: DataFrame) -> DataFrame:
    """One row per page object of successful results; ``page_value`` is the page. The place stands in for a missing page_index."""
    pages = jsonx.array_at(jsonx.parsed(F.col("payload")), "result.pages")
    rows = results.where("status = 'success'").select("uid", "item_id", F.posexplode(pages).alias("pos", "page_value")).where(jsonx.kind(F.col("page_value")) == "object")
    get = lambda path, to: jsonx.at(F.col("page_value"), path, to)
    index = F.coalesce(get("page_index", "bigint"), F.col("pos").cast("bigint"))
    segments = F.filter(jsonx.array_at(F.col("page_value"), "segments"), lambda x: jsonx.kind(x) == "object")
    return rows.select(
        "uid", "item_id", (index + 1).alias("page_no"), index.alias("page_index"), get("cid", "bigint").alias("cid"), get("duration", "double").alias("duration_s"),
        get("language", "string").alias("language"), get("asr_model", "string").alias("asr_model"), F.coalesce(get("text", "string"), F.lit("")).alias("transcript_text"),
        F.length(F.coalesce(get("text", "string"), F.lit(""))).cast("bigint").alias("transcript_char_count"), F.size(segments).cast("bigint").alias("segment_count"), segments.alias("segments"),
    )


def materialise_pages(results: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Derived page rows: those of touched items go, new ones come from successful results only."""
    new = explode_pages(results).select(*PAGE_COLUMNS)
    return new if stored is None else stored.join(results.select("uid", "item_id").distinct(), ["uid", "item_id"], "left_anti").unionByName(new)


def materialise_segments(results: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Derived segment rows; language and model fall back to the page's, flags are 0 or 1, times double or null."""
    rows = explode_pages(results).select("uid", "item_id", "page_no", "language", "asr_model", F.posexplode("segments").alias("pos", "s"))
    get = lambda path, to: jsonx.at(F.col("s"), path, to)
    flag = lambda path: F.coalesce(get(path, "boolean").cast("bigint"), F.lit(0).cast("bigint"))
    new = rows.select(
        "uid", "item_id", "page_no", (F.col("pos") + 1).cast("bigint").alias("segment_no"), *(safe_double(get(c, "string")).alias(c) for c in ("start_s", "end_s", "duration")),
        F.coalesce(get("text", "string"), F.lit("")).alias("transcript_text"), F.coalesce(get("language", "string"), "language").alias("language"), F.coalesce(get("model", "string"), "asr_model").alias("asr_model"),
        flag("empty_transcript_skip").alias("is_empty_transcript_skip"), flag("high_risk_skip").alias("is_high_risk_audio_skip"), get("error", "string").alias("error_message"),
    )
    return new if stored is None else stored.join(results.select("uid", "item_id").distinct(), ["uid", "item_id"], "left_anti").unionByName(new)


def patch_map_entry(df: DataFrame, map_col: str, key: str, status: Column, items: Column, coverage: Column) -> DataFrame:
    """Rows whose map entry ``key`` has a new status, and items and coverage where they are given."""
    old = F.try_element_at(F.col(map_col), F.lit(key))
    entry = F.struct(status.alias("status"), F.coalesce(items, old["items"]).alias("items"), F.coalesce(coverage, old["coverage"]).alias("coverage"))
    others = F.map_filter(F.col(map_col), lambda k, v: k != key)
    return df.withColumn(map_col, F.map_concat(others, F.create_map(F.lit(key), entry)))


def meta_touch(changes: DataFrame) -> DataFrame:
    """uid, key and value of the last-done marks that task changes (uid, stage, status, at_ms) set; failures count too."""
    key = F.when(F.col("stage") == "fetching", "last_fetched_at_ms").otherwise("last_processed_at_ms")
    done = changes.where(~F.col("status").isin("PENDING", "RUNNING"))
    return done.groupBy("uid", key.alias("key")).agg(F.max("at_ms").cast("string").alias("value"))


def update_task_status(tasks: DataFrame, meta: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, meta) after status changes (uid, stage, status, at_ms, seq): the last one of each stored task counts, and each that ends a task sets its mark."""
    last = changes.groupBy("uid", "stage").agg(F.max_by(F.struct(F.col("status").alias("new_status"), F.col("at_ms").alias("new_at_ms")), "seq").alias("last"))
    joined = tasks.join(last.select("uid", "stage", "last.*"), ["uid", "stage"], "left")
    updated = {"status": F.coalesce("new_status", "status"), "updated_at_ms": F.coalesce("new_at_ms", "updated_at_ms")}
    # the mark follows a change also where the task is not stored
    ended = changes.where(~F.col("status").isin("PENDING", "RUNNING")).groupBy("uid", "stage").agg(F.max_by("at_ms", "seq").alias("at_ms"))
    marks = meta_touch(ended.withColumn("status", F.lit("SUCCESS")))
    return joined.withColumns(updated).select(*tasks.columns), meta.join(marks, ["uid", "key"], "left_anti").unionByName(marks)


def purge_uid(tables: dict[str, DataFrame], uid: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without an account, and what went as (table, removed)."""
    kept = {name: df.where(F.col("uid") != uid) for name, df in tables.items()}
    gone = [df.where(F.col("uid") == uid).agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed") for name, df in tables.items()]
    return kept, reduce(DataFrame.unionByName, gone)


def merge_legacy(current: DataFrame, legacy: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """``current`` plus the legacy rows that it lacks; rows that do not pass ``keep`` are dropped."""
    return current.unionByName(legacy.where(keep).join(current, keys, "left_anti"), allowMissingColumns=True)


#: fixed values: schema versions that a merge knows, and the marks that it carries over
VERSION, OLDER_VERSION, LEGACY_VERSION = "3", "2", "4"
CARRIED = ("last_fetched_at_ms", "last_processed_at_ms")


def merge_blockers(meta: DataFrame, legacy_meta: DataFrame) -> DataFrame:
    """uid and ``blocked``, why an account is not merged: its own version, or that of its legacy store if it has one, is not known; null if it is merged."""
    version = lambda df, name: df.groupBy("uid").agg(F.max(F.when(F.col("key") == "schema_version", F.col("value"))).alias(name), F.lit(True).alias(f"has_{name}"))
    both = version(meta, "own").join(version(legacy_meta, "legacy"), "uid", "full")
    odd = lambda name, *known: ~F.coalesce(F.col(name).isin(*known), F.lit(False))
    why = F.when(F.col("has_own").isNull(), "no current store").when(odd("own", VERSION, OLDER_VERSION), "current version").when(F.col("has_legacy") & odd("legacy", LEGACY_VERSION), "legacy version")
    return both.select("uid", why.alias("blocked"))


def merge_meta(meta: DataFrame, legacy_meta: DataFrame) -> DataFrame:
    """Marks after a merge: the legacy ones are carried over, the version is the newest; blocked accounts stay as they are."""
    fine = merge_blockers(meta, legacy_meta).where("blocked is null").select("uid")
    carried = legacy_meta.where(F.col("key").isin(*CARRIED)).join(fine, "uid", "left_semi").select("uid", "key", "value")
    bumped = fine.select("uid", F.lit("schema_version").alias("key"), F.lit(VERSION).alias("value"))
    new = carried.unionByName(bumped)
    return meta.select("uid", "key", "value").join(new, ["uid", "key"], "left_anti").unionByName(new)


#: fixed values: tables that a legacy store is merged into, their keys, and the condition on rows that are carried over
MERGED: dict[str, tuple[list[str], str]] = {
    "audio_transcription": (["uid", "item_id"], "true"),
    "audio_transcription_page": (["uid", "item_id", "page_no"], "true"),
    "audio_transcription_segment": (["uid", "item_id", "page_no", "segment_no"], "true"),
    "stage_run": (["run_id"], "true"),
    "stage_error": (["uid", "id"], "true"),
    "fetch_endpoint_state": (["uid", "endpoint"], "true"),
    "stage_task": (["uid", "stage"], "stage <> 'parsing'"),
    "stage_event": (["uid", "id"], "stage <> 'parsing'"),
}


def merge_store(current: dict[str, DataFrame], legacy: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(rows to add to each table, marks, report) of a merge of legacy stores into current ones, account by account.

    Both hold ``meta`` and any of the tables of ``MERGED``. An account is merged whole or
    not at all: ``merge_blockers`` decides, for its rows as for its marks and its
    version. Of legacy rows with one key the one that orders first is taken.
    The report has, for each account and table, the legacy rows that were copied, are
    there already, were dropped (a retired stage) or refused (the account is blocked),
    and ``blocked``, why.
    """
    gate = merge_blockers(current["meta"], legacy["meta"])
    fine = gate.where("blocked is null").select("uid", F.lit(True).alias("__fine"))
    added, reports = {}, []
    for name, (keys, carried) in MERGED.items():
        if name not in legacy:
            continue
        rows = legacy[name].join(fine, "uid", "left").withColumn("__carried", F.coalesce(F.expr(carried), F.lit(True)))
        there = current[name].select(*keys).distinct().withColumn("__there", F.lit(True)) if name in current else None
        rows = rows.join(there, keys, "left") if there is not None else rows.withColumn("__there", F.lit(None).cast("boolean"))
        merged, known = F.col("__fine").isNotNull(), F.col("__there").isNotNull()
        rest = [c for c in legacy[name].columns if c not in keys]
        new = rows.where(merged & F.col("__carried") & ~known)
        added[name] = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*").select(*legacy[name].columns) if rest else new.select(*keys).distinct()
        counts = rows.groupBy("uid").agg(
            F.count_distinct(F.when(merged & F.col("__carried") & ~known, F.struct(*keys))).alias("copied"), F.count_if(merged & F.col("__carried") & known).alias("existing"),
            F.count_if(merged & ~F.col("__carried")).alias("dropped"), F.count_if(~merged).alias("refused"),
        )
        reports.append(counts.select("uid", F.lit(name).alias("table"), "copied", "existing", "dropped", "refused"))
    report = reduce(DataFrame.unionByName, reports).join(gate, "uid", "left")
    # an account that neither store has marks of cannot be merged either
    why = F.when(F.col("refused") > 0, F.coalesce("blocked", F.lit("no current store")))
    return added, merge_meta(current["meta"], legacy["meta"]), report.withColumn("blocked", why)


def merge_report(current: DataFrame, legacy: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """copied, existing and dropped counts of a legacy merge."""
    marked = legacy.withColumn("__keep", keep).join(current.select(*keys, F.lit(True).alias("__there")).distinct(), keys, "left")
    n = lambda c: F.count_if(c)
    return marked.agg(n(F.col("__keep") & F.col("__there").isNull()).alias("copied"), n(F.col("__keep") & F.col("__there").isNotNull()).alias("existing"), n(~F.col("__keep")).alias("dropped"))


def commit_pages(pages: DataFrame, progress: DataFrame, root: str, version: int) -> None:
    """Write pages and then progress under one version; the marker comes last and makes it valid."""
    pages.write.mode("overwrite").parquet(f"{root}/v={version}/pages")
    progress.write.mode("overwrite").parquet(f"{root}/v={version}/progress")
    pages.sparkSession.range(1).selectExpr(f"cast({version} as bigint) as version").coalesce(1).write.mode("overwrite").json(f"{root}/committed/v={version}")


def read_committed(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """Pages and progress of the newest version that has its marker."""
    version = spark.read.json(f"{root}/committed").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v={version}/pages"), spark.read.parquet(f"{root}/v={version}/progress")
