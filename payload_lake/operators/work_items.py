"""Rows out of nested payloads: work items, per-page sub-resources and subtitles, typed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..sources.views import LISTINGS, OF_ENDPOINT, SINGLE, Field

KEYS = ["uid", "item_id"]


def work_items(payloads: DataFrame) -> DataFrame:
    """One row per page of each item: page_index (its place in the list), cid, duration_s, part.

    Pages that are no objects are left out but keep their place; an item without
    usable pages gives one row from its own cid and duration; a payload that does
    not parse or is no object gives none. Bad numbers count as 0.
    """
    rows = payloads.where("item_id <> ''").select(*KEYS, jsonx.parsed(F.col("payload")).alias("v")).where(jsonx.kind(F.col("v")) == "object")
    number = lambda v, path: F.coalesce(F.when(jsonx.kind(jsonx.at(v, path)).isin("integer", "number", "string"), jsonx.at(v, path, "bigint")), F.lit(0).cast("bigint"))
    listed = F.transform(jsonx.array_at(F.col("v"), "info.pages"), lambda p, i: F.when(jsonx.kind(p) == "object", F.struct(
        i.cast("bigint").alias("page_index"), number(p, "cid").alias("cid"), number(p, "duration").alias("duration_s"), F.coalesce(jsonx.at(p, "part", "string"), F.lit("")).alias("part"))))
    usable = F.array_compact(listed)
    single = F.array(F.struct(F.lit(0).cast("bigint").alias("page_index"), number(F.col("v"), "info.cid").alias("cid"), number(F.col("v"), "info.duration").alias("duration_s"), F.lit("").alias("part")))
    pages = rows.select(*KEYS, usable.alias("pages"), single.alias("single"))
    return pages.select(*KEYS, F.explode(F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.col("single"))).alias("p")).select(*KEYS, "p.*")


def explode_subresource(payloads: DataFrame, key: str) -> DataFrame:
    """Rows of ``{pages: [...], <key>: [{page_index, cid, part, result}]}``; result as JSON text."""
    rows = payloads.select(*KEYS, F.posexplode(jsonx.array_at(jsonx.parsed(F.col("payload")), key)).alias("pos", "r"))
    get = lambda path, to: jsonx.at(F.col("r"), path, to)
    return rows.select(*KEYS, F.coalesce(get("page_index", "bigint"), F.col("pos").cast("bigint")).alias("page_index"), get("cid", "bigint").alias("cid"), get("part", "string").alias("part"), F.to_json(get("result", "variant")).alias("result"))


def subtitle_rows(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects): per page and language the cues; a language with a fetch error goes to the rejects alone.

    The i-th entry of the page's subtitle index belongs to the i-th body.
    """
    pages = payloads.select(*KEYS, F.explode(jsonx.array_at(jsonx.parsed(F.col("payload")), "subtitle")).alias("s"))
    bodies = pages.select(*KEYS, jsonx.at(F.col("s"), "page_index", "bigint").alias("page_index"), jsonx.array_at(F.col("s"), "result.subtitles").alias("index"), F.posexplode(jsonx.array_at(F.col("s"), "content")).alias("pos", "c"))
    entry = F.try_element_at(F.col("index"), F.col("pos") + 1)
    named = bodies.select(*KEYS, "page_index", F.coalesce(jsonx.at(F.col("c"), "lan", "string"), jsonx.at(entry, "lan", "string")).alias("lan"), "c", jsonx.at(F.col("c"), "_fetch_error", "string").alias("error"))
    cues = named.where("error is null").select(*KEYS, "page_index", "lan", F.posexplode(jsonx.array_at(F.col("c"), "body")).alias("cue", "b"))
    get = lambda path, to: jsonx.at(F.col("b"), path, to)
    return cues.select(*KEYS, "page_index", "lan", "cue", get("from", "double").alias("from_s"), get("to", "double").alias("to_s"), get("content", "string").alias("content")), named.where("error is not null").select(*KEYS, "page_index", "lan", "error")


def _record(fields: list[Field]) -> tuple[str | None, dict[str, str]]:
    """Schema of the struct that holds the first paths of the fields, and where each field is in it.

    Paths with an index, without a name, or through what another field takes whole are left out.
    """
    tree: dict = {}
    placed: dict[str, str] = {}
    for f in fields:
        parts = f.paths[0].split(".")
        if "[" in f.paths[0] or not all(parts):
            continue
        node = tree
        for part in parts[:-1]:
            node = node.setdefault(part, {}) if isinstance(node, dict) else None
        if isinstance(node, dict) and parts[-1] not in node:
            node[parts[-1]] = f.type
            placed[f.name] = ".".join(f"`{x}`" for x in parts)
    ddl = lambda node: node if isinstance(node, str) else "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in node.items()) + ">"
    return (ddl(tree) if placed else None), placed


def _typed(rows: DataFrame, value: str, fields: list[Field]) -> DataFrame:
    """``rows`` with the fields of the variant column ``value`` in its place.

    One cast to a struct reads the first paths of all fields, wrong types as null; the
    other paths are looked up only in rows where that gave nothing, and whether a text is
    an object or a list only where it begins like one.
    """
    schema, placed = _record(fields)
    others = [c for c in rows.columns if c != value]
    read = rows.withColumn("__record", F.try_variant_get(F.col(value), "$", schema)) if schema else rows

    def column(f: Field) -> Column:
        slow = [_scalar(F.col(value), p, f.type) for p in f.paths]
        if f.name not in placed:
            return F.coalesce(*slow).alias(f.name)
        first = F.col(f"__record.{placed[f.name]}")
        if f.type == "string":
            first = F.when(~first.startswith("{") & ~first.startswith("["), first).when(first.isNotNull(), slow[0])
        return F.coalesce(first, *slow[1:]).alias(f.name)

    return read.select(*others, *map(column, fields))


def _scalar(value: Column, path: str, to: str) -> Column:
    """The value at a path; an object or list is no text."""
    found = jsonx.at(value, path, to)
    return F.when(~jsonx.kind(jsonx.at(value, path)).isin("object", "array"), found) if to == "string" else found


def typed_view(payloads: DataFrame, view: str) -> DataFrame:
    """Typed columns of an endpoint's payloads; listings give one row per entry, with page and pos.

    A path of the wrong shape gives null or no row; unknown fields stay in the payload.
    """
    own = payloads.where(F.col("endpoint") == OF_ENDPOINT.get(view, view)).select(*KEYS, jsonx.parsed(F.col("payload")).alias("v"))
    if view in SINGLE:
        return _typed(own, "v", SINGLE[view])
    listing = LISTINGS[view]
    pages = F.posexplode(jsonx.array_at(F.col("v"), "pages")) if listing.paged else F.posexplode(F.array("v"))
    rows = own.select(*KEYS, pages.alias("page", "p")).select(*KEYS, "page", F.posexplode(jsonx.array_at(F.col("p"), listing.path)).alias("pos", "r"))
    return _typed(rows, "r", listing.fields)
