"""Schemas of the eleven tables, scans of a lake of accounts, and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

#: columns of the tables besides uid
SCHEMAS = {
    "meta": "key string, value string",
    "raw_payload": "endpoint string, item_id string, payload string, fetched_at_ms long, seq long",
    "fetch_progress": "endpoint string, cursor string, total long, fetched long, updated_at_ms long",
    "audio_transcription": "item_id string, status string, transcription_source string, transcript string, audio_tokens long, seconds double, cache_hits long, payload string, processed_at_ms long",
    "audio_transcription_page": "item_id string, page_no long, page_index long, cid long, duration_s double, language string, asr_model string, transcript_text string, transcript_char_count long, segment_count long",
    "audio_transcription_segment": "item_id string, page_no long, segment_no long, start_seconds double, end_seconds double, duration_s double, transcript_text string, language string, asr_model string, is_empty_transcript_skip long, is_high_risk_audio_skip long, error_message string",
    "stage_task": "stage string, status string, payload string, created_at_ms long, updated_at_ms long",
    "fetch_endpoint_state": "endpoint string, status string, retry_count long, last_error_id long, item_progress string, progress string, updated_at_ms long",
    "stage_error": "id long, stage string, endpoint string, pipeline string, item_type string, item_id string, error_type string, message string, retryable long, detail string, occurred_at_ms long",
    "stage_run": "run_id string, command string, status string, started_at_ms long, ended_at_ms long, args_json string, summary_json string",
    "stage_event": "id long, run_id string, ts_ms long, level string, stage string, event string, endpoint string, pipeline string, item_type string, item_id string, message string, data_json string",
    "segment_cache": "item_id string, page_index long, version long, start_s double, end_s double, text string, language string, duration double, model string, audio_tokens long, backend string",
}
LOG_SCHEMA = "type string, run_id string, uid long, command string, ts_ms long, id long, level string, stage string, event string, endpoint string, message string, data string, status string, summary string"

#: partition column of the tables, and how many folders a table has at most: a folder for each account costs more than its rows once there are many.
#: A prime, so that ids with a common factor spread; accounts with ids below it have folders of their own.
BUCKET, BUCKETS = "bucket_of_uid", 251


def _with_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.col("uid").cast("bigint"), F.lit(BUCKETS)).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def _reader(spark: SparkSession, table: str) -> DataFrameReader:
    return spark.read.schema(f"{SCHEMAS[table]}, uid long, {BUCKET} int")


def read_table(spark: SparkSession, root: str, table: str, uid: int | None = None) -> DataFrame:
    """A table of all accounts, or of one: then only the folder it lies in is listed, and row groups of other accounts are passed over."""
    path = f"{root}/{table}"
    if uid is None:
        return _reader(spark, table).parquet(path).drop(BUCKET)
    own = f"{path}/{BUCKET}={uid % BUCKETS}"
    if _exists(spark, own):
        return scoped(_reader(spark, table).option("basePath", path).parquet(own), uid).drop(BUCKET)
    return spark.createDataFrame([], f"{SCHEMAS[table]}, uid long")


def read_accounts(spark: SparkSession, root: str, table: str, accounts: DataFrame, small: int = 100_000) -> DataFrame:
    """A table of the accounts in column ``uid`` of ``accounts``, wherever that list comes from.

    A list of at most ``small`` ids is broadcast, and Spark prunes the partitions of the
    scan by it at run time; a longer one is joined by shuffling.
    """
    wanted = _with_bucket(list_uids(accounts))
    short = wanted.limit(small + 1).count() <= small
    return _reader(spark, table).parquet(f"{root}/{table}").join(F.broadcast(wanted) if short else wanted, [BUCKET, "uid"], "left_semi").drop(BUCKET)


def scoped(df: DataFrame, uid: int | None) -> DataFrame:
    return df if uid is None else df.where(F.col("uid") == uid)


def write_table(df: DataFrame, root: str, table: str) -> None:
    """Replace the accounts that ``df`` has, and only those; rows are sorted for row-group pruning.

    Tasks take sampled ranges of account and key, so a large account is written by several
    of them. Accounts share ``BUCKETS`` folders; what other accounts have in the folders of
    ``df`` is written again, so two jobs must not write one table at once, and a replacement
    that breaks off in its commit can lose them too (``commits`` is for that). ``df`` then is computed three times.
    """
    spark, path = df.sparkSession, f"{root}/{table}"
    order = [c for c in ("endpoint", "item_id", "run_id", "id", "key") if c in df.columns]
    rows = _with_bucket(df)
    if _exists(spark, path):
        folders, own = [r[0] for r in rows.select(BUCKET).distinct().collect()], df.select(F.col("uid").alias("own_uid")).distinct()
        beside = _reader(spark, table).parquet(path).where(F.col(BUCKET).isin([b for b in folders if b is not None]) | (F.lit(None in folders) & F.col(BUCKET).isNull()))
        rows = rows.unionByName(beside.join(own, F.col("uid").eqNullSafe(F.col("own_uid")), "left_anti"), allowMissingColumns=True)
    rows.repartitionByRange(BUCKET, "uid", *order).sortWithinPartitions(BUCKET, "uid", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def list_uids(df: DataFrame, name: str = "uid") -> DataFrame:
    """Distinct account ids; names that are no positive integers are left out."""
    found = df.select(F.col(name).cast("string").try_cast("bigint").alias("uid")).where("uid > 0")
    return found.distinct()


#: column for a line of a log that is no JSON
BROKEN = "broken"


def read_run_log(spark: SparkSession, path: str, streaming: bool = False, broken: bool = False, files_at_once: int | None = None) -> DataFrame:
    """Records of a run log of JSON lines; ``type`` is run.started, event or run.completed.

    With ``broken``, a line that is no JSON stands in the column of that name;
    without, such a line is a row of nulls. A stream takes ``files_at_once`` new files in a batch.
    """
    reader = (spark.readStream if streaming else spark.read).schema(f"{LOG_SCHEMA}, {BROKEN} string" if broken else LOG_SCHEMA)
    if broken:
        reader = reader.option("columnNameOfCorruptRecord", BROKEN)
    if streaming and files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.json(path)


def split_run_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, events): a run has its start and, once known, its end."""
    started = log.where("type = 'run.started'").select("run_id", "uid", "command", F.col("ts_ms").alias("started_at_ms"))
    ended = log.where("type = 'run.completed'").select("run_id", "status", F.col("ts_ms").alias("ended_at_ms"), "summary")
    return started.join(ended, "run_id", "full"), log.where("type = 'event'").select("run_id", "uid", "id", "ts_ms", "level", "stage", "event", "endpoint", "message", F.col("data").alias("data_json"))
