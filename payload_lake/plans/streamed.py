"""Streaming queries run to the end of what is there (available now), read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upserts
from ..sources import commits, tables
from ..sources.scratch import scratch
from ..streaming import events as streams
from ..streaming import upserted
from .registered import ATTENTION
from .stand_ins import STAND_INS, oracle, stand_in

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(names: str = "", sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(names, sql)
        return f

    return add


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, one micro-batch per few files."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{path}*")
    raw.createOrReplaceTempView("payload_lake_events")
    return spark.sql(STAND_INS["fx_event"].format(events="payload_lake_events")).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(started) -> None:
    started.awaitTermination()
    if started.exception():
        raise started.exception()


@query("fx_event", "SELECT id, run_id, uid, level, event, data_json FROM fx_event")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "events")
    rows = event_stream(spark, sf_dir).select("id", "run_id", "uid", "level", "event", "data_json")
    finished(streams.ingest_events(rows, f"{out}/data", f"{out}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{out}/data")


@query("fx_event", f"SELECT id, uid, event FROM fx_event WHERE {ATTENTION}")
def stream_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "attention")
    rows = streams.stream_attention(event_stream(spark, sf_dir)).select("id", "uid", "event")
    finished(streams.ingest_events(rows, f"{out}/data", f"{out}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{out}/data")


LAST_EVENTS = "SELECT uid, event, arg_max(id, id) AS id, arg_max(level, id) AS level, max(id) AS seq FROM fx_event GROUP BY uid, event"


@query("fx_event", LAST_EVENTS)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "upsert")
    rows = event_stream(spark, sf_dir).select("uid", "event", "id", "level", F.col("id").alias("seq"))
    finished(upserted.stream_upsert(rows, f"{out}/table", ["uid", "event"], f"{out}/checkpoint"))
    return upserted.read_upserts(spark, f"{out}/table", ["uid", "event"])


@query("fx_event", f"SELECT *, true AS seen_before FROM ({LAST_EVENTS})")
def stream_upsert_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten batches, merged three at a time, then into one set, under a reader of the version before; ``seen_before``: that reader has the row too."""
    out, keys = scratch(spark, "levels"), ["uid", "event"]
    rows = stand_in(spark, sf_dir, "fx_event").select("uid", "event", "id", "level", F.col("id").alias("seq"))
    for part in range(10):
        rows.where(F.pmod("id", F.lit(10)) == part).coalesce(1).write.mode("append").parquet(f"{out}/changes")
    changes = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/changes")
    finished(upserted.stream_upsert(changes, f"{out}/table", keys, f"{out}/checkpoint", fan_in=3))
    reader = upserted.read_upserts(spark, f"{out}/table", keys)
    upserted.compact(spark, f"{out}/table", keys)
    commits.vacuum(spark, f"{out}/table", keep=2)
    before = reader.select(*keys, F.col("seq").alias("seq_before"))
    newest = upserted.read_upserts(spark, f"{out}/table", keys).join(before, keys, "left")
    return newest.select("uid", "event", "id", "level", "seq", F.coalesce(F.col("seq_before") == F.col("seq"), F.lit(False)).alias("seen_before"))


@query("fx_event", """SELECT run_id, endpoint, CAST(day AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (WHERE event LIKE '%.saved' OR event LIKE '%.completed') AS completed, count(*) FILTER (WHERE event LIKE '%.failed') AS failed, count(*) FILTER (WHERE event LIKE '%.skipped') AS skipped
FROM (SELECT split_part(run_id, '-', 1) AS run_id, split_part(event, '.', 1) AS endpoint, CAST(ts AS DATE) AS day, CASE WHEN event = 'asr.segment.rate_limited' THEN 'asr.segment.skipped' ELSE event END AS event FROM fx_event) GROUP BY ALL""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each user's run, endpoint and day. Each micro-batch writes the counts that it changed; the last of each stands.

    The runs here go over many days, each of which is a row of its own.
    """
    out = scratch(spark, "progress")
    events = event_stream(spark, sf_dir).withColumn("endpoint", F.substring_index("event", ".", 1)).withColumn("run_id", F.substring_index("run_id", "-", 1))
    counts = streams.stream_progress(events.withColumn("event", F.when(F.col("event") == "asr.segment.rate_limited", "asr.segment.skipped").otherwise(F.col("event"))))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("seq", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/v={number}")

    finished(counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    rows = spark.read.parquet(f"{out}/data").withColumn("day", F.to_date("day_start").cast("string"))
    return upserts.merge_coalesce(rows, ["run_id", "endpoint", "day"], ["total", "completed", "failed", "skipped"], [])


CLOSING = "closing"


@query("fx_event", """WITH e AS (SELECT uid AS run_id, (epoch_us(ts) // 24) AS us, event = 'asr.discovery.completed' AS ended FROM fx_event),
s AS (SELECT *, sum(starts) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (
 SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY run_id ORDER BY us) < 900000000 THEN 0 ELSE 1 END AS starts FROM e))
SELECT run_id, max(us) // 1000 AS last_ts_ms FROM s GROUP BY run_id, session HAVING NOT bool_or(ended)""")
def stream_stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All silences of 15 minutes in which a run has not ended; a user's events at 24 times their pace are its run.

    Files are read in any order, so the watermark waits for years, and a closing event
    beyond that makes all alerts due.
    """
    out = scratch(spark, "stale")
    faster = F.timestamp_micros(F.floor(F.unix_micros("ts") / 24).cast("bigint"))
    events = event_stream(spark, sf_dir).select(F.col("uid").cast("string").alias("run_id"), F.when(F.col("event") == "asr.discovery.completed", "run.completed").otherwise(F.col("event")).alias("event"), faster.alias("ts"))
    newest = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    closing = newest.where("ts is not null").select(F.lit(CLOSING).alias("run_id"), F.lit("run.completed").alias("event"), (F.col("ts") + F.expr("interval 4000 days")).alias("ts"))
    closing.write.parquet(f"{out}/closing")
    alerts = streams.stream_stale_runs(events.unionByName(spark.readStream.schema(closing.schema).parquet(f"{out}/closing")), watermark="3650 days")
    finished(alerts.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    found = spark.read.schema(alerts.schema).parquet(f"{out}/data").where(F.col("run_id") != CLOSING)
    return found.select(F.col("run_id").cast("bigint").alias("run_id"), "last_ts_ms")


@query("fx_run", """WITH r AS (SELECT run_id, uid, command, epoch_us(started_at) // 1000 AS s, CASE WHEN uid % 8 = 1 THEN epoch_us(started_at) // 1000 + 3 * 86400000 ELSE epoch_us(ended_at) // 1000 END AS e FROM fx_run)
SELECT run_id, CASE WHEN uid % 8 <> 2 THEN uid END AS uid, CASE WHEN uid % 8 <> 2 THEN command END AS command, CASE WHEN uid % 8 <> 2 THEN s END AS started_at_ms,
 CASE WHEN uid % 8 > 1 THEN 'SUCCESS' END AS status, CASE WHEN uid % 8 > 1 THEN e END AS ended_at_ms FROM r
UNION ALL SELECT run_id, NULL, NULL, NULL, 'SUCCESS', e FROM r WHERE uid % 8 = 1""")
def stream_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log that grows file by file, read as a stream: ends that come later, too late (two rows) or never, and starts that were lost."""
    path = scratch(spark, "growing-log")
    runs = stand_in(spark, sf_dir, "fx_run").withColumn("k", F.col("uid") % 8)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    late = F.when(F.col("k") == 1, ms("started_at") + 3 * 86_400_000).otherwise(ms("ended_at"))
    started = runs.where("k <> 2").select(F.lit("run.started").alias("type"), "run_id", "uid", "command", ms("started_at").alias("ts_ms"))
    ended = runs.where("k <> 0").select(F.lit("run.completed").alias("type"), "run_id", late.alias("ts_ms"), F.lit("SUCCESS").alias("status"))
    # a record of either type long after all others: what is still open is given out
    newest = runs.agg(F.max(ms("ended_at")).alias("ts_ms")).where("ts_ms is not null")
    closing = newest.select(F.explode(F.array(F.lit("run.started"), F.lit("run.completed"))).alias("type"), F.lit(CLOSING).alias("run_id"), (F.col("ts_ms") + 200 * 86_400_000).alias("ts_ms"))
    for part in (started, ended, closing):
        part.write.mode("append").json(path)
    found = streams.stream_runs(tables.read_run_log(spark, path, streaming=True, files_at_once=4), watermark="60 days")
    out = scratch(spark, "runs")
    finished(streams.ingest_events(found, f"{out}/data", f"{out}/checkpoint"))
    return spark.read.schema(found.schema).parquet(f"{out}/data").where(F.col("run_id") != CLOSING).drop("summary")


@query("fx_event", """SELECT 'event' AS kind, id, run_id, level FROM fx_event WHERE id % 11 <> 0 AND id % 13 <> 0
UNION ALL SELECT 'reject', id, NULL, NULL FROM fx_event WHERE id % 11 = 0 OR id % 13 = 0""")
def stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines with broken lines, lines of unknown type and repeated ones, ingested as a stream into events and rejects."""
    path, out = scratch(spark, "event-log"), scratch(spark, "event-table")
    rows = stand_in(spark, sf_dir, "fx_event").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    kind = F.when(F.col("id") % 13 == 0, "noise").otherwise("event").alias("type")
    line = F.to_json(F.struct(kind, "id", "run_id", "uid", "ts_ms", "level", "event", F.col("data_json").alias("data")))
    lines = rows.select("id", F.when(F.col("id") % 11 == 0, F.concat(F.lit('{"type":"event","id":'), F.col("id").cast("string"))).otherwise(line).alias("value"))
    lines.select("value").write.mode("append").text(path)
    lines.where("id % 5 = 0 and id % 11 <> 0 and id % 13 <> 0").select("value").write.mode("append").text(path)
    for started in streams.ingest_event_log(tables.read_run_log(spark, path, streaming=True, broken=True, files_at_once=8), out, f"{out}/checkpoint", watermark="3650 days"):
        finished(started)
    events = spark.read.parquet(f"{out}/events").select(F.lit("event").alias("kind"), "id", "run_id", "level")
    rejects = spark.read.schema("line string").parquet(f"{out}/rejects").select(F.lit("reject").alias("kind"), F.regexp_extract("line", r'"id":(\d+)', 1).cast("bigint").alias("id"))
    return events.unionByName(rejects, allowMissingColumns=True)


@query("fx_event", f"SELECT 'all' AS sink, count(*) AS n FROM fx_event UNION ALL SELECT 'attention', count(*) FROM fx_event WHERE {ATTENTION}")
def fanout_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "sinks")

    def table_sink(batch: DataFrame, number: int) -> None:
        batch.select("id").write.mode("overwrite").parquet(f"{out}/all/v={number}")

    def json_sink(batch: DataFrame, number: int) -> None:
        streams.stream_attention(batch).select("id").write.mode("overwrite").json(f"{out}/attention/v={number}")

    finished(streams.write_events(event_stream(spark, sf_dir), [table_sink, json_sink], f"{out}/checkpoint"))
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "n")
    return counted(spark.read.schema("id long").parquet(f"{out}/all"), "all").unionByName(counted(spark.read.schema("id long").json(f"{out}/attention"), "attention"))


@query("fx_listing", "SELECT uid, count(DISTINCT page_no) AS pages, count(*) AS fetched FROM fx_listing GROUP BY uid")
def commit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and progress committed as version 2 over an unfinished version 3, which readers do not see."""
    root = scratch(spark, "commits")
    pages = stand_in(spark, sf_dir, "fx_listing")
    progress = pages.groupBy("uid").agg(F.count("*").alias("fetched"))
    upserts.commit_pages(pages, progress, root, 2)
    pages.limit(0).write.parquet(f"{root}/v=3/pages")
    got_pages, got_progress = upserts.read_committed(spark, root)
    return got_pages.groupBy("uid").agg(F.countDistinct("page_no").alias("pages")).join(got_progress, "uid")


@query("fx_run fx_event", "SELECT r.run_id, r.uid, r.command, 'SUCCESS' AS status, r.n_events FROM fx_run r")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log written as JSON lines and read back: runs with their status and number of events."""
    path = scratch(spark, "run-log")
    runs, log = stand_in(spark, sf_dir, "fx_run"), stand_in(spark, sf_dir, "fx_event")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias("ts_ms")
    started = runs.select(F.lit("run.started").alias("type"), "run_id", "uid", "command", ms("started_at"))
    ended = runs.select(F.lit("run.completed").alias("type"), "run_id", ms("ended_at"), F.lit("SUCCESS").alias("status"))
    events = log.select(F.lit("event").alias("type"), "run_id", "uid", ms("ts"), "id", "level", "event", F.col("data_json").alias("data"))
    started.unionByName(ended, allowMissingColumns=True).unionByName(events, allowMissingColumns=True).write.json(path)
    read_runs, read_events = tables.split_run_log(tables.read_run_log(spark, path))
    return read_runs.select("run_id", "uid", "command", "status").join(read_events.groupBy("run_id").agg(F.count("*").alias("n_events")), "run_id")
