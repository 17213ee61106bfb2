"""Stand-in tables derived from the given ones; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("orders", "lineitem", "events", "documents", "labels", "conversations", "customer", "part")

STAND_INS = {
    "fx_detail": """
select o_custkey as uid, cast(o_orderkey as varchar(20)) as item_id, o_orderpriority as title,
       cast(floor(o_totalprice / 1000) as bigint) as duration_s, o_orderdate as published_at
from {orders}""",
    "fx_page": """
select uid, item_id, rn - 1 as page_index, cid, duration_s, part from (
  select o.o_custkey as uid, cast(l.l_orderkey as varchar(20)) as item_id, l.l_partkey as cid,
         cast(l.l_quantity as bigint) as duration_s, l.l_returnflag as part,
         row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity) as rn
  from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey) t""",
    "fx_listing": """
select uid, cast(floor((rn - 1) / 5) as bigint) + 1 as page_no, rn as pos, item_id from (
  select o_custkey as uid, cast(o_orderkey as varchar(20)) as item_id,
         row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
  from {orders}) t""",
    "fx_result": """
select o_custkey as uid, cast(o_orderkey as varchar(20)) as item_id,
       case when o_orderstatus = 'F' then 'success' when o_orderstatus = 'P' then 'failed'
            when o_orderpriority = '1-URGENT' then 'pending' when o_orderpriority = '2-HIGH' then 'running' else 'skipped' end as status,
       cast(floor(o_totalprice / 1000) as bigint) as seconds, cast(o_orderkey % 4 as bigint) as cache_hits
from {orders} where o_orderstatus in ('F', 'P') or o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "fx_run": """
select concat(cast(user_id as varchar(20)), '-', cast(cast(ts as date) as varchar(20))) as run_id, user_id as uid,
       case when sum(case when event_type = 'purchase' then 1 else 0 end) > 0 then 'asr' else 'fetch' end as command,
       min(ts) as started_at, max(ts) as ended_at, count(*) as n_events
from {events} group by user_id, cast(ts as date)""",
    "fx_event": """
select event_id as id, concat(cast(user_id as varchar(20)), '-', cast(cast(ts as date) as varchar(20))) as run_id, user_id as uid, ts,
       case event_type when 'error' then 'ERROR' when 'click' then 'WARNING' else 'INFO' end as level,
       case event_type when 'error' then 'fetch.item.failed' when 'click' then 'asr.segment.rate_limited'
            when 'view' then 'fetch.item.saved' when 'purchase' then 'asr.discovery.completed' else 'asr.segment.high_risk_split' end as event,
       props as data_json
from {events}""",
    "fx_error": """
select event_id as id, user_id as uid, case when event_id % 2 = 0 then 'fetching' else 'asr' end as stage,
       case cast(event_id % 5 as int) when 0 then 'ResourceUnavailableError' when 1 then 'AuthError' when 2 then 'Http412Error' when 3 then 'Http5xxError' else 'RequestError' end as error_type,
       case cast(event_id % 3 as int) when 0 then 0 when 1 then 1 end as retryable, props as detail, ts
from {events} where event_type = 'error'""",
    "fx_change": """
select l_orderkey as k1, l_linenumber as k2, l_quantity as v, l_returnflag as status,
       case when l_linestatus = 'O' then l_partkey end as maybe_null,
       row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as seq
from {lineitem}""",
    "fx_segment": """
select conv_id as item, turn as pos, role, text, length(text) as n_chars, case when role = 'system' then 1 else 0 end as is_empty_skip from {conversations}""",
    "fx_coverage": """
select d.doc_id as item_id, case when l.doc_id is null then 'missing' when l.toxic = 1 then 'failed' when l.quality = 1 then 'success' else 'skipped' end as state
from {documents} d left join {labels} l on l.doc_id = d.doc_id""",
    "fx_cached": """
select user_id as item, event_id as id, value as start_s, value + 10 as end_s, event_type as ns from {events} where event_id % 2 = 0""",
    "fx_wanted": """
select user_id as item, event_id as id, value as start_s, value + 10 as end_s, event_type as ns from {events} where event_id % 2 = 1""",
    "fx_frame": """
select user_id as clip, row_number() over (partition by user_id order by ts) - 1 as frame, case when event_type in ('view', 'click', 'purchase') then 1 else 0 end as is_speech from {events}""",
}


def stand_in(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table, or a given table by its own name."""
    if name not in STAND_INS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = STAND_INS[name]
    if name == "fx_change":
        return _changes(spark, sf_dir)
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log; seq is numbered within ship days, and days are offset by their counts, so no task sorts the whole table."""
    from pyspark.sql import Window as W

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = lines.groupBy("l_shipdate").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("l_shipdate").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    place = F.row_number().over(W.partitionBy("l_shipdate").orderBy(*order))
    return lines.withColumn("place", place).join(before, "l_shipdate").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_quantity").alias("v"), F.col("l_returnflag").alias("status"),
        F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("maybe_null"), (F.col("before") + F.col("place")).alias("seq"),
    )


def oracle(names: str, sql: str) -> str:
    """DuckDB SQL with the named stand-ins as common table expressions."""
    parts = [f"{n} AS ({STAND_INS[n].format(**{t: t for t in BASE})})" for n in names.split()]
    sql = sql.strip()
    if not parts:
        return sql
    if sql[:15].upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + sql[15:]
    return "WITH " + ", ".join(parts) + (", " + sql[5:] if sql[:5].upper() == "WITH " else " " + sql)
