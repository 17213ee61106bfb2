"""Registered queries of all typed views: payloads made of orders and read back by the views; the SQL works on the orders alone.

Of each entry every seventh value is missing, and every eleventh that is no text has a
shape that does not fit its type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.work_items import typed_view
from ..sources.views import LISTINGS, OF_ENDPOINT, SINGLE
from .registered import query

PAGE = 3
#: registered elsewhere, from payloads of their own
OTHERS = ("space_notice", "video_detail", "videos", "up_stat", "all_followings")
VALUES = {
    "string": "concat('f{i} ', cast(o_orderkey + {i} as varchar(20)))", "bigint": "cast(o_orderkey + {i} as bigint)",
    "double": "cast(o_orderkey + {i} as double) / 4", "boolean": "(o_orderkey + {i}) % 2 = 0",
}


def _fields(view: str) -> list[tuple[int, str, str, str]]:
    """Number, name, first path and type of each field of a view."""
    fields = SINGLE[view] if view in SINGLE else LISTINGS[view].fields
    return [(i, f.name, f.paths[0], f.type) for i, f in enumerate(fields)]


def _leaf(i: int, kind: str) -> Column:
    """JSON text of the i-th value of an entry."""
    value, key = F.expr(VALUES[kind].format(i=i)).cast("string"), F.col("o_orderkey") + i
    text = F.concat(F.lit('"'), value, F.lit('"')) if kind == "string" else value
    odd = text if kind == "string" else F.lit('"x"')
    return F.when(key % 7 == 0, F.lit("null")).when(key % 11 == 0, odd).otherwise(text)


def _object(leaves: dict[str, Column]) -> Column:
    """JSON text of an object with values at dot paths."""
    inner: dict[str, dict[str, Column]] = {}
    for path, text in leaves.items():
        head, _, rest = path.partition(".")
        inner.setdefault(head, {})[rest] = text
    parts = [F.concat(F.lit(f'"{head}":'), rest[""] if "" in rest else _object(rest)) for head, rest in inner.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _payloads(t, view: str) -> DataFrame:
    orders = t("orders").select(F.col("o_custkey").alias("uid"), "o_orderkey", _object({path: _leaf(i, kind) for i, _, path, kind in _fields(view)}).alias("entry"))
    endpoint = F.lit(OF_ENDPOINT.get(view, view)).alias("endpoint")
    if view in SINGLE:
        return orders.select("uid", F.col("o_orderkey").cast("string").alias("item_id"), endpoint, F.col("entry").alias("payload"))
    listing = LISTINGS[view]
    rows = orders.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "entry"))), lambda x: x["entry"]).alias("entries"))
    page = lambda entries: _object({listing.path: F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))})
    starts = F.sequence(F.lit(1), F.size("entries"), F.lit(PAGE))
    pages = F.concat(F.lit('{"pages":['), F.array_join(F.transform(starts, lambda s: page(F.slice("entries", s, PAGE))), ","), F.lit("]}"))
    return rows.select("uid", F.lit("").alias("item_id"), endpoint, (pages if listing.paged else page(F.col("entries"))).alias("payload"))


def _sql(view: str) -> str:
    columns = ", ".join(f"CASE WHEN (o_orderkey + {i}) % 7 = 0{'' if kind == 'string' else f' OR (o_orderkey + {i}) % 11 = 0'} THEN NULL ELSE {VALUES[kind].format(i=i)} END AS {name}" for i, name, _, kind in _fields(view))
    if view in SINGLE:
        return f"SELECT o_custkey AS uid, CAST(o_orderkey AS VARCHAR) AS item_id, {columns} FROM orders"
    page, pos = (f"(n - 1) // {PAGE}", f"(n - 1) % {PAGE}") if LISTINGS[view].paged else ("0", "n - 1")
    return f"SELECT o_custkey AS uid, '' AS item_id, CAST({page} AS INTEGER) AS page, CAST({pos} AS INTEGER) AS pos, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"


def _register(view: str) -> None:
    def run(t) -> DataFrame:
        return typed_view(_payloads(t, view), view)

    run.__name__ = f"typed_{view}"
    query("", _sql(view))(run)


for _view in [*SINGLE, *LISTINGS]:
    if _view not in OTHERS:
        _register(_view)


@query("", "SELECT o_custkey AS uid, CAST(o_orderkey AS VARCHAR) AS item_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS text FROM orders")
def typed_space_notice(t):
    """The payload is a text by itself; every third one is broken."""
    text = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))).otherwise("{")
    return typed_view(t("orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").cast("string").alias("item_id"), F.lit("space_notice").alias("endpoint"), text.alias("payload")), "space_notice")


#: payloads of orders written out by hand, in all variants that the contract names; {k} is the order's key plus one
VARIANTS = {
    "overview_stat": (
        '{"video": {k}, "article": {"article_count": {k}1}, "opus": {k}2, "album": "{k}"}',
        '{"video": {"video_count": {k}}, "article_count": {k}1, "opus": {"opus_count": {k}2}, "album": {"odd": 1}}',
        '{"video_count": {k}, "article": {k}1, "opus_count": {k}2}',
    ),
    "up_stat": (
        '{"archive": {"view": {k}}, "article": {"view": {k}1}, "likes": {k}2}',
        '{"archive": {k}, "article": {k}1, "likes": {k}2}',
        '{"archive": {k}, "article": {"view": {k}1}, "likes": {k}2}',
    ),
    "user_info": (
        '{"mid": {k}, "name": "n{k}1", "vip": {"type": {k}2, "label": {"text": "v{k}"}}}',
        '{"mid": "{k}", "name": "n{k}1", "vip": {"type": {k}2, "label": "v{k}"}}',
        '{"mid": {k}, "name": "n{k}1", "vip": {"type": "{k}2", "label": {"text": "v{k}", "path": "p"}}, "unknown": [1]}',
    ),
    "dynamics": (
        '{"pages": [{"items": [{"id_str": "d{k}", "modules": {"module_author": {"mid": {k}1, "pub_ts": {k}2}, "module_dynamic": {"major": {"type": "ARCHIVE", "archive": {"bvid": "b{k}"}}}}}]}]}',
        '{"pages": [{"items": [{"id_str": "d{k}", "modules": [{"module_author": {"mid": {k}1, "pub_ts": "{k}2"}}]}, 7]}, {"items": 3}]}',
        '{"pages": [{"items": []}, {"items": [{"id_str": "d{k}", "modules": [{"module_author": {"mid": "{k}1", "pub_ts": {k}2}}]}]}]}',
    ),
}


def _variant_rows(t, view: str) -> DataFrame:
    k = (F.col("o_orderkey") + 1).cast("string")
    texts = [F.concat(*(x for part in template.split("{k}") for x in (F.lit(part), k))) for template in VARIANTS[view]]
    # the join of the parts ends in one key too many
    payload = F.element_at(F.array(*(F.substr(x, F.lit(1), F.length(x) - F.length(k)) for x in texts)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = t("orders").select(F.col("o_custkey").alias("uid"), k.alias("item_id"), F.lit(view).alias("endpoint"), payload.alias("payload"))
    return typed_view(rows, view)


@query("", """WITH o AS (SELECT o_custkey AS uid, CAST(o_orderkey + 1 AS VARCHAR) AS k, o_orderkey % 3 AS v FROM orders)
SELECT 'overview_stat' AS view, uid, k AS item_id, k AS a, k || '1' AS b, k || '2' AS c, CASE WHEN v = 0 THEN k END AS d FROM o
UNION ALL SELECT 'up_stat', uid, k, k, k || '1', k || '2', NULL FROM o
UNION ALL SELECT 'user_info', uid, k, k, 'n' || k || '1', k || '2', 'v' || k FROM o
UNION ALL SELECT 'dynamics', uid, k, 'd' || k, k || '1', k || '2', CASE WHEN v = 0 THEN 'b' || k END FROM o
UNION ALL SELECT 'dynamics', uid, k, NULL, NULL, NULL, NULL FROM o WHERE v = 1""")
def typed_variants(t):
    """The views whose payloads come in several shapes, read from each of these."""
    columns = {"overview_stat": ("videos", "articles", "opus", "album"), "up_stat": ("archive_views", "article_views", "likes", None), "user_info": ("mid", "name", "vip_type", "vip_label"), "dynamics": ("id", "author_mid", "published_s", "bvid")}
    text = lambda c, name: (F.lit(None) if c is None else F.col(c)).cast("string").alias(name)
    parts = [_variant_rows(t, view).select(F.lit(view).alias("view"), "uid", "item_id", *map(text, names, "abcd")) for view, names in columns.items()]
    return reduce(DataFrame.unionByName, parts)
