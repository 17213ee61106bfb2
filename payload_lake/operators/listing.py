"""Stored listings: completeness, merging, incremental boundary and paging loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import numbered


def known_ids(pages: DataFrame) -> DataFrame:
    """Distinct ids of a stored listing; ``pages`` has uid and the array ``ids``."""
    return pages.select("uid", F.explode("ids").alias("item_id")).distinct()


def listing_completeness(pages: DataFrame) -> DataFrame:
    """Per account the first positive total, the number of known ids and whether the listing is complete.

    ``pages``: uid, page_no, total, is_open (an open cursor), ids. An open cursor
    on the last page makes it incomplete.
    """
    first = F.min_by("total", F.when(F.col("total") > 0, F.col("page_no")))
    totals = pages.groupBy("uid").agg(first.alias("total"), F.coalesce(F.max_by("is_open", "page_no"), F.lit(False)).alias("is_open"))
    counted = known_ids(pages).groupBy("uid").agg(F.count("*").alias("known"))
    rows = totals.join(counted, "uid", "left").select("uid", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("known", F.lit(0)).alias("known"), "is_open")
    return rows.withColumn("complete", ~F.col("is_open") & (F.col("known") >= F.col("total")))


def merge_listing(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages that are kept, fresh ones first: those without ids, or with an id not on an earlier page.

    Both have uid, page_no and ids; the result adds ``is_stored`` and ``ord``. A
    page that is dropped brings nothing new, so the first place of each id decides.
    Pages of one account are numbered by many tasks.
    """
    both = fresh.select("uid", "page_no", "ids", F.lit(0).alias("is_stored")).unionByName(stored.select("uid", "page_no", "ids", F.lit(1).alias("is_stored")))
    ordered = numbered(both, ["uid"], ["is_stored", "page_no"], "ord")
    ids = ordered.select("uid", "ord", F.explode("ids").alias("id"))
    first = ids.groupBy("uid", "id").agg(F.min("ord").alias("ord"))
    bring = first.select("uid", "ord").distinct()
    empty = ordered.where(F.size("ids") == 0)
    return ordered.where(F.size("ids") > 0).join(bring, ["uid", "ord"], "left_semi").unionByName(empty)


def incremental_boundary(pages: DataFrame, known: DataFrame, incomplete: DataFrame) -> DataFrame:
    """``pages`` up to the boundary and one page after it, with ``new_ids`` and ``boundary``.

    The boundary is the first page whose ids are all known, from the store or
    from earlier pages; in accounts of ``incomplete`` only the last page counts.
    """
    rows = pages.select("uid", "page_no", F.explode_outer("ids").alias("item_id"))
    first = rows.groupBy("uid", "item_id").agg(F.min("page_no").alias("first_page"))
    stored = known.select("uid", "item_id", F.lit(True).alias("is_known")).distinct()
    marked = rows.join(first, ["uid", "item_id"], "left").join(stored, ["uid", "item_id"], "left")
    new = F.countDistinct(F.when(F.col("is_known").isNull() & (F.col("first_page") == F.col("page_no")), F.col("item_id")))
    per_page = marked.groupBy("uid", "page_no").agg(new.alias("new_ids"), F.count("item_id").alias("ids"))
    last = per_page.groupBy("uid").agg(F.max("page_no").alias("last_page"))
    held = per_page.join(last, "uid").join(incomplete.select("uid", F.lit(True).alias("is_incomplete")).distinct(), "uid", "left")
    counts = (F.col("new_ids") == 0) & (F.col("ids") > 0) & (F.col("is_incomplete").isNull() | (F.col("page_no") == F.col("last_page")))
    boundary = held.groupBy("uid").agg(F.min(F.when(counts, F.col("page_no"))).alias("boundary"))
    return per_page.join(boundary, "uid").where("boundary is null or page_no <= boundary + 1").select("uid", "page_no", "new_ids", "boundary")


def paging_loops(requests: DataFrame, by: list[str]) -> DataFrame:
    """Groups in which a request comes twice: at which ``seq`` first, pages till then, fetched ids, mismatch with the total.

    ``requests``: the columns of ``by``, seq, request_key, fetched, total.
    """
    twice = requests.withColumn("nth", F.row_number().over(W.partitionBy(*by, "request_key").orderBy("seq")))
    loop = twice.groupBy(*by).agg(F.min(F.when(F.col("nth") == 2, F.col("seq"))).alias("loop_seq")).where("loop_seq is not null")
    upto = requests.join(loop, by).where("seq < loop_seq")
    return upto.groupBy(*by, "loop_seq").agg(F.count("*").alias("pages"), F.max("total").alias("total"), F.sum("fetched").alias("fetched")).withColumn("mismatch", F.col("fetched") != F.col("total"))


def new_ids(page_ids: DataFrame, known: DataFrame) -> DataFrame:
    return page_ids.select("uid", "item_id").distinct().join(known, ["uid", "item_id"], "left_anti")


def merge_subpages(pages: DataFrame, by: list[str]) -> DataFrame:
    """One list of ids per group from its pages in order, and its length."""
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "ids"))), lambda x: x["ids"]))
    return pages.groupBy(*by).agg(ids.alias("ids")).withColumn("n", F.size("ids"))


def write_listing(stored: DataFrame, fresh: DataFrame, mode: str) -> DataFrame:
    """Pages of a listing after a run: incremental merges, full replaces, resume appends."""
    if mode == "incremental":
        return merge_listing(fresh, stored).select("uid", "page_no", "ids", "is_stored")
    fresh = fresh.select("uid", "page_no", "ids", F.lit(0).alias("is_stored"))
    if mode == "full":
        return fresh.unionByName(stored.join(fresh.select("uid").distinct(), "uid", "left_anti").select("uid", "page_no", "ids", F.lit(1).alias("is_stored")))
    if mode == "resume":
        return stored.select("uid", "page_no", "ids", F.lit(1).alias("is_stored")).unionByName(fresh)
    raise ValueError(f"unknown mode: {mode}")
