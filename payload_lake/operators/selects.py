"""Projections, filters, look-ups and top-k over payloads, errors and results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.scalars import is_attention

#: fixed values: named subsets of the endpoints; None stands for all
PROFILES: dict[str, tuple[str, ...] | None] = {"all": None, "minimal": ("user_info", "videos", "articles", "opus", "dynamics")}
#: fixed values
KNOWN_TASKS = ("PENDING", "RUNNING", "SUCCESS", "PARTIAL", "FAILED", "FAILED_RETRYABLE", "FAILED_EXHAUSTED", "FAILED_PERMANENT")
KNOWN_STATES = ("PENDING", "RUNNING", "SUCCESS", "PARTIAL_ITEM", "FAILED_RETRYABLE", "FAILED_EXHAUSTED", "FAILED_PERMANENT")


def payload_for(payloads: DataFrame, endpoint: str, item_id: str = "") -> DataFrame:
    """Payload and fetch time of one key per account; the empty item id is the endpoint's own row."""
    return payloads.where((F.col("endpoint") == endpoint) & (F.col("item_id") == item_id)).select("uid", "payload", "fetched_at_ms")


def completed_items(payloads: DataFrame, endpoint: str) -> DataFrame:
    return payloads.where((F.col("endpoint") == endpoint) & (F.col("item_id") != "")).select("uid", "item_id")


def fanout_records(payloads: DataFrame, endpoint: str) -> DataFrame:
    return payloads.where((F.col("endpoint") == endpoint) & (F.col("item_id") != "")).select("uid", "item_id", "payload", "fetched_at_ms")


def parse_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a VARIANT ``value`` that are objects, rows that do not parse or are no object, with the kind)."""
    read = payloads.withColumn("value", jsonx.parsed(F.col("payload"))).withColumn("kind", F.coalesce(jsonx.kind(F.col("value")), F.lit("broken")))
    return read.where("kind = 'object'"), read.where("kind <> 'object'").drop("value")


def errors(rows: DataFrame, **filters: str | int) -> DataFrame:
    """Errors with a three-valued ``retryable`` and the detail decoded; ``filters`` are column = value."""
    for name, value in filters.items():
        rows = rows.where(F.col(name) == value)
    return rows.withColumn("retryable", F.col("retryable").cast("boolean")).withColumn("detail_value", jsonx.parsed(F.col("detail")))


def recent_errors(rows: DataFrame, stage: str, n: int = 20) -> DataFrame:
    return rows.where(F.col("stage") == stage).orderBy(F.desc("id")).limit(n)


def items_by_status(results: DataFrame, status: str | None = None) -> DataFrame:
    return (results if status is None else results.where(F.col("status") == status)).select("uid", "item_id", "status")


def resolve_subset(registry: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, profile: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen rows with ``place``, unknown names). Include keeps the given order (name, place), exclude and a profile the registry's."""
    if sum(x is not None for x in (include, exclude, profile)) > 1:
        raise ValueError("give include, exclude or profile, not several")
    if profile is not None:
        if profile not in PROFILES:
            raise ValueError(f"unknown profile: {profile}")
        members = PROFILES[profile]
        return registry if members is None else registry.where(F.col("name").isin(*members)), registry.select("name").limit(0)
    given = include if include is not None else exclude
    if given is None:
        return registry, registry.select("name").limit(0)
    unknown = given.select("name").join(registry, "name", "left_anti")
    if include is not None:
        return registry.drop("place").join(include.select("name", "place"), "name"), unknown
    return registry.join(exclude.select("name"), "name", "left_anti"), unknown


def checked_subset(registry: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, profile: str | None = None) -> DataFrame:
    """The chosen rows of ``resolve_subset``; unknown names and an empty rest are errors. Names are configuration."""
    chosen, unknown = resolve_subset(registry, include, exclude, profile)
    odd = sorted(r["name"] for r in unknown.collect())
    if odd:
        raise ValueError(f"unknown names: {', '.join(odd)}")
    if chosen.isEmpty():
        raise ValueError("nothing is left to run")
    return chosen


def discover_candidates(items: DataFrame, status: DataFrame, mode: str = "incremental", only: DataFrame | None = None, exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Items (uid, item_id) of each account that are ready, with ``skipped``: how many of its items were done before.

    Order of the tests: only, exclude, readiness by ``mode`` (incremental, full,
    retry_failed), then the first ``limit`` ids of each account in binary order.
    """
    if only is not None:
        items = items.join(only, ["uid", "item_id"], "left_semi")
    if exclude is not None:
        items = items.join(exclude, ["uid", "item_id"], "left_anti")
    known = items.select("uid", "item_id").join(status.select("uid", "item_id", "status"), ["uid", "item_id"], "left")
    done = F.coalesce(F.col("status") == "success", F.lit(False))
    ready = {"incremental": ~done, "full": F.lit(True), "retry_failed": F.coalesce(F.col("status") == "failed", F.lit(False))}[mode]
    judged = known.select("uid", "item_id", ready.alias("ready"), done.alias("done"))
    skipped = judged.groupBy("uid").agg(F.count_if("done" if mode == "incremental" else F.lit(False)).alias("skipped"))
    out = judged.where("ready").select("uid", "item_id")
    if limit is not None:
        out = out.withColumn("place", F.row_number().over(W.partitionBy("uid").orderBy("item_id"))).where(F.col("place") <= limit).drop("place")
    return out.join(skipped, "uid")


def attention_events(events: DataFrame) -> DataFrame:
    return events.where(is_attention(F.col("level"), F.col("event")))


def scope_events(events: DataFrame, runs: DataFrame, uid: int | None = None, run_id: str | None = None) -> DataFrame:
    """Events of one run, or of the runs of one account."""
    if run_id is not None:
        return events.where(F.col("run_id") == run_id)
    return events.drop("uid").join(runs.where(F.col("uid") == uid).select("run_id", "uid"), "run_id")


#: fixed values: content kinds that are not articles
NOT_ARTICLES = {"template_id": (4,), "origin_template_id": (5,), "category_id": (41, 42), "type": (0, 2, 3, 4)}


def skip_reason(template_id: Column, origin_template_id: Column, category_id: Column, kind: Column) -> Column:
    """Why a listed item is not fetched as an article: all four kinds fit; else null."""
    columns = {"template_id": template_id, "origin_template_id": origin_template_id, "category_id": category_id, "type": kind}
    fits = reduce(lambda a, b: a & b, [columns[name].isin(*values) for name, values in NOT_ARTICLES.items()])
    return F.when(fits, F.lit("a note or an opus, not an article"))


def article_skip(item: Column) -> Column:
    """Why an entry of an article listing is not fetched, or null."""
    get = lambda path: jsonx.at(item, path, "bigint")
    return skip_reason(get("template_id"), get("origin_template_id"), get("category.id"), get("type"))


#: for each item endpoint that has one, the rule by which entries of its listing are skipped
SKIP_RULES: dict[str, Callable[[Column], Column]] = {"article_detail": article_skip}


def fanout_items(payloads: DataFrame, endpoint: str, source: str) -> DataFrame:
    """uid, pos, item_id and skip reason of each entry of the listing ``source`` for an item endpoint.

    The listing's path of items and the endpoint's skip rule are looked up; an
    endpoint without a rule skips nothing.
    """
    *lists, key = jsonx.ITEM_PATHS[source][0].split("[*].")
    found = jsonx.array_at(jsonx.parsed(F.col("payload")), lists[0])
    for path in lists[1:]:
        found = F.flatten(F.transform(found, jsonx.at_each(path)))
    rows = payloads.where((F.col("endpoint") == source) & (F.col("item_id") == "")).select("uid", F.posexplode(found).alias("pos", "item"))
    reason = SKIP_RULES[endpoint](F.col("item")) if endpoint in SKIP_RULES else F.lit(None).cast("string")
    return rows.select("uid", "pos", jsonx.at(F.col("item"), key, "string").alias("item_id"), reason.alias("reason")).where("item_id is not null")


def skip_filtered(items: DataFrame, reason: Column) -> DataFrame:
    """Of each listed id, the item found first decides; ids with a reason go."""
    first = items.withColumn("reason", reason).groupBy("uid", "item_id").agg(F.min_by(F.struct("reason"), "pos").alias("first"))
    return items.join(first.where("first.reason is not null"), ["uid", "item_id"], "left_anti")


def endpoint_states(states: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Stored states; a status that is not known is shown as PENDING."""
    shown = states.withColumn("status", F.when(F.col("status").isin(*KNOWN_STATES), F.col("status")).otherwise("PENDING"))
    return shown if names is None else shown.where(F.col("endpoint").isin(*names))


def task_states(tasks: DataFrame, stage: str | None = None) -> DataFrame:
    """uid, stage, status and updated_at_ms of the tasks; a status that is not known is shown as PENDING."""
    shown = F.when(F.col("status").isin(*KNOWN_TASKS), F.col("status")).otherwise("PENDING").alias("status")
    return (tasks if stage is None else tasks.where(F.col("stage") == stage)).select("uid", "stage", shown, "updated_at_ms")


def meta_value(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") == key).select("uid", "value")


def newest_items(items: DataFrame, n: int = 50, time: str = "published_ms") -> DataFrame:
    return items.orderBy(F.desc_nulls_last(time), F.desc("item_id")).limit(n)
