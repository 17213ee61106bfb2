"""JSON payload functions on VARIANT columns; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: first words of VARIANT schemas; any other one is a number
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null"}


def parsed(payload: Column) -> Column:
    """The payload as VARIANT; null for null, empty or broken text."""
    return F.try_parse_json(payload)


def kind(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null; null where there is no value."""
    names = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(names, word), F.lit("number")))


def at(value: Column, path: str, to: str = "variant") -> Column:
    """The value at a dot path, null on any miss."""
    return F.try_variant_get(value, f"$.{path}" if path else "$", to)


def array_at(value: Column, path: str) -> Column:
    """The array at a dot path as array<variant>, empty if it is missing or not an array."""
    return F.coalesce(at(value, path, "array<variant>"), F.array().cast("array<variant>"))


def object_or_empty(text: Column) -> Column:
    """Tolerant decode: anything but a JSON object becomes an empty object."""
    value = parsed(text)
    return F.when(kind(value) == "object", value).otherwise(F.parse_json(F.lit("{}")))


def path_values(value: Column, path: str) -> Column:
    """Texts at a path with ``[*]`` expansions, in order; wrong types give nothing and nulls are left out.

    Without an expansion a list gives all its elements and a scalar itself.
    """
    *lists, last = path.split("[*]")
    last = last.strip(".")
    if not lists:
        many = F.transform(array_at(value, last), lambda x: x.cast("string"))
        one = F.array(at(value, last, "string"))
        return F.filter(F.when(kind(at(value, last)) == "array", many).otherwise(one), lambda x: x.isNotNull())
    found = array_at(value, lists[0].strip("."))
    for part in lists[1:]:
        found = F.flatten(F.transform(found, at_each(part.strip("."))))
    texts = F.transform(found, lambda x: at(x, last, "string") if last else x.cast("string"))
    return F.filter(texts, lambda x: x.isNotNull())


def at_each(path: str) -> Callable[[Column], Column]:
    return lambda x: array_at(x, path)


def extract_ids(value: Column, paths: list[str]) -> Column:
    """The ids at several paths, in path order, duplicates kept."""
    return F.concat(*(path_values(value, p) for p in paths))


#: fixed values: id paths of the listings that items are derived from
ITEM_PATHS = {
    "videos": ["pages[*].list.vlist[*].bvid"],
    "articles": ["pages[*].articles[*].id"],
    "opus": ["pages[*].items[*].opus_id"],
    "article_list": ["lists[*].id"],
    "channel_list_seasons": ["pages[*].items_lists.seasons_list[*].meta.season_id"],
    "channel_list_series": ["pages[*].items_lists.series_list[*].meta.series_id"],
    "upower_qa": ["pages[*].list[*].qa_id"],
}


def extract_items(value: Column, listing: str) -> Column:
    """Item ids of a named listing as texts; empty video ids are left out."""
    ids = extract_ids(value, ITEM_PATHS[listing])
    return F.filter(ids, lambda x: x != "") if listing == "videos" else ids


#: fixed values: keys under which responses keep their list, and paths of their total
LIST_KEYS = ("list", "items", "archives", "data", "media_list")
TOTAL_PATHS = ("page.count", "page.total", "items_lists.page.total", "total", "count", "total_count", "totalSize")


#: fixed values: where the page strategy looks for a total when the first one is 0
PAGE_TOTALS = ("page.count", "totalSize", "items_lists.page.total", "count", "total_count")


def find_items(value: Column, path: str | None = None) -> Column:
    """The list of a response as array<variant>, by its path or by the usual keys; empty if there is none."""
    none = F.array().cast("array<variant>")
    if path:
        inside = at(value, path)
        every = F.flatten(F.transform(F.map_values(F.coalesce(at(value, path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))), lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), none)))
        named = [at(inside, k, "array<variant>") for k in LIST_KEYS]
        as_object = F.when(kind(inside) == "object", F.coalesce(*named, every))
        return F.when(kind(inside) == "array", at(value, path, "array<variant>")).otherwise(F.coalesce(as_object, _by_keys(value)))
    return _by_keys(value)


def _by_keys(value: Column) -> Column:
    found = []
    for key in (*LIST_KEYS, "cards"):
        found.append(at(value, key, "array<variant>"))
        found += [at(value, f"{key}.{nested}", "array<variant>") for nested in LIST_KEYS]
    return F.coalesce(*found, F.array().cast("array<variant>"))


def find_total(value: Column) -> Column:
    """The first integer (booleans count as 0 and 1) at the known total paths, else 0."""
    found = []
    for path in TOTAL_PATHS:
        here = kind(at(value, path))
        found.append(F.when(here == "integer", at(value, path, "bigint")).when(here == "boolean", at(value, path, "boolean").cast("bigint")))
    return F.coalesce(*found, F.lit(0).cast("bigint"))


def wrap_result(value: Column, key: str = "data") -> Column:
    """Objects as they are; a list or scalar as ``{key: value}``; as JSON text."""
    text = F.to_json(value)
    return F.when(kind(value) == "object", text).otherwise(F.concat(F.lit(f'{{"{key}":'), text, F.lit("}")))


def next_page(value: Column, strategy: str, page: Column, size: Column, items_path: str | None = None) -> tuple[Column, Column]:
    """(is_last, next parameter as text) of a response under a paging strategy."""
    flag = kind(at(value, "has_more"))
    more = F.coalesce(F.when(flag.isin("integer", "number"), at(value, "has_more", "double") == 1).when(flag == "boolean", at(value, "has_more", "boolean")), F.lit(False))
    items, total = find_items(value, items_path), find_total(value)
    n = F.size(items)
    if strategy == "page":
        whole = lambda path: F.when(kind(at(value, path)) == "integer", at(value, path, "bigint"))
        # a total of 0 gives way to the totals of other shapes of a response
        total = F.coalesce(F.when(total != 0, total), *(F.when(whole(p) != 0, whole(p)) for p in PAGE_TOTALS), F.lit(0).cast("bigint"))
        last = (n == 0) | (total > 0) & (page * size >= total)
        following = (page + 1).cast("string")
    elif strategy == "cursor":
        last, following = ~more, F.coalesce(at(value, "offset", "string"), F.lit(""))
    elif strategy == "anchor":
        anchor = at(value, "anchor", "string")
        last, following = F.coalesce(anchor, F.lit("0")).isin("0", "", "false"), anchor
    elif strategy == "legacy_offset":
        offset = at(value, "next_offset", "string")
        last, following = ~more | F.coalesce(offset, F.lit("0")).isin("0", "", "false"), offset
    elif strategy == "oid":
        tail = F.try_element_at(items, F.lit(-1))
        following = F.coalesce(*(F.when(~at(tail, k, "string").isin("0", "", "false"), at(tail, k, "string")) for k in ("aid", "id", "oid", "param")))
        last = (n == 0) | (total > 0) & (n >= total) | following.isNull() | (n < size)
    elif strategy == "none":
        last, following = F.lit(True), F.lit(None).cast("string")
    else:
        raise ValueError(f"unknown paging strategy: {strategy}")
    return last, F.when(~last, following)


def truthy(value: Column) -> Column:
    """Whether a value counts as given: true, a number but 0, a text, list or object that is not empty."""
    here = kind(value)
    size = F.coalesce(F.size(at(value, "", "array<variant>")), F.lit(0))
    found = (
        F.when(here == "boolean", at(value, "", "boolean")).when(here.isin("integer", "number"), at(value, "", "double") != 0)
        .when(here == "string", at(value, "", "string") != "").when(here == "array", size > 0).when(here == "object", F.to_json(value) != "{}")
    )
    return F.coalesce(found, F.lit(False))


def decode_cursor(text: Column) -> tuple[Column, Column]:
    """(JSON value, plain text): text that starts with a brace or bracket is JSON if it parses, else plain."""
    value = F.when(F.substring(text, 1, 1).isin("{", "["), parsed(text))
    return value, F.when(value.isNull(), text)
