"""Sharding by the minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one atomic group. Groups stand in the order of a
128-bit hash of their text, after the few groups that alone exceed an even share
(each of these gets a shard of its own). The smallest capacity for which a
greedy sweep needs no more than the shards at hand is found by binary search,
and the sweep at that capacity gives the cuts.

The sweep needs prefix sums at the cut points only, so the driver never holds
the groups: it holds byte sums of at most ``2 ** bin_bits`` key ranges, learns from them
in which ranges a cut can lie at all, and asks Spark for finer sums of those
ranges alone, until the ranges that matter hold at most ``exact`` groups, which
it then sums exactly. Every level divides what is left by a large factor.

Defined cases: a null text counts as empty and weighs the overhead alone; equal
rows get different slots; an empty table gives no rows; fewer groups than shards
leave shards empty.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stage import staged, table


def smallest_capacity(prefix: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The least capacity by which a greedy sweep fits the groups into ``shards``, and the cuts.

    ``prefix`` holds 0 and the running sums of the group sizes; a cut is the
    number of groups before it.
    """
    total, n = int(prefix[-1]), len(prefix) - 1

    def sweep(capacity: int) -> list[int] | None:
        cuts, at = [], 0
        for _ in range(shards):
            at = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
            if at == n:
                return cuts
            cuts.append(at)
        return None

    low = max(-(-total // shards), int(np.diff(prefix).max(initial=0)))
    high = max(low, total)
    while low < high:
        middle = (low + high) // 2
        if sweep(middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, sweep(low) or []


def _cut_ranges(edges: np.ndarray, shards: int) -> np.ndarray:
    """Which bins can hold a cut of the best sweep, given the sums at the bins' edges only.

    ``edges`` are prefix sums at the bin borders. A sweep that may cut anywhere
    inside a bin bounds the best capacity from below, one that may only cut at
    bin borders from above; between the two, the j-th cut lies between the
    positions that the two reach.
    """
    total, n = int(edges[-1]), len(edges) - 1
    low = -(-total // shards)
    high, _ = smallest_capacity(edges, shards)
    mark = np.zeros(n + 1, np.int64)
    first = last = 0
    for _ in range(shards):
        # never further right than an unbroken stretch of `high`, never further left than whole bins of `low`
        last = min(total, last + high)
        at = int(np.searchsorted(edges, first + low, side="right")) - 1
        first = int(edges[at])
        mark[min(at, n - 1)] += 1
        mark[min(int(np.searchsorted(edges, last, side="left")), n)] -= 1
        if first >= total:
            break
    return np.cumsum(mark)[:n] > 0


def cut_keys(groups: DataFrame, shards: int, bin_bits: int = 14, exact: int = 200_000) -> list[tuple[int, int]]:
    """The (h1, h2) keys at which a new shard starts; ``groups`` has h1, h2 and size.

    The driver holds at most about 2 ** bin_bits sums, or ``exact`` group sizes.
    Key ranges are (start, bits): the keys from start to start + 2 ** bits - 1.
    """
    if shards < 2:
        return []
    opened, settled = [(-(1 << 63), 64)], []
    while True:
        held = groups.where(reduce(lambda a, b: a | b, [F.col("h1").between(first, last) for first, last in _joined(opened)]))
        if held.count() <= exact or opened[0][1] == 0:
            rows = [((r.h1, r.h2), int(r["size"])) for r in held.select("h1", "h2", "size").collect()]
            items = sorted(rows + [((start, -(1 << 63)), size) for start, _, size in settled])
            _, cuts = smallest_capacity(_running([size for _, size in items]), shards)
            return [items[c][0] for c in cuts]
        bits = max(0, min(opened[0][1] - 1, (len(opened) << opened[0][1]).bit_length() - bin_bits))
        sums = held.groupBy(F.shiftright("h1", bits).alias("bin")).agg(F.sum("size").alias("size")).collect()
        ranges = sorted([(r["bin"] << bits, bits, int(r["size"])) for r in sums] + settled)
        can = _cut_ranges(_running([size for *_, size in ranges]), shards)
        known = set(settled)
        opened = [r[:2] for r, c in zip(ranges, can, strict=True) if c and r not in known]
        settled = [r for r, c in zip(ranges, can, strict=True) if not c or r in known]


def _running(sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last keys, neighbouring ranges as one."""
    out: list[tuple[int, int]] = []
    for start, bits in sorted(ranges):
        last = start + (1 << bits) - 1
        if out and out[-1][1] + 1 == start:
            out[-1] = (out[-1][0], last)
        else:
            out.append((start, last))
    return out


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, slot_rows: int = 5_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``.

    The law is ``bytes``: shards are as equal in size as their order and the
    atomic groups allow. Slots number the rows of a shard in the order of a hash
    of doc_id, in pieces of about ``slot_rows`` rows whose offsets are summed
    first, so no task numbers a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text).alias("h2"),
        ),
        "sizes",
    )
    groups = staged(rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long"), F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()
    rest, left, alone = total[0], shards, []
    for g in groups.orderBy(F.desc("size"), "h1", "h2").limit(shards - 1).collect():
        if g["size"] * left <= rest:
            break
        alone.append((g.h1, g.h2))
        rest, left = rest - g["size"], left - 1
    is_alone = [(F.col("h1") == a) & (F.col("h2") == b) for a, b in alone]
    others = groups.where(~reduce(lambda a, b: a | b, is_alone)) if is_alone else groups
    cuts = cut_keys(others, left) if rest else []
    number = F.lit(len(alone))
    for a, b in cuts:
        number = number + F.when((F.col("h1") > a) | ((F.col("h1") == a) & (F.col("h2") >= b)), 1).otherwise(0)
    for i, one in enumerate(is_alone):
        number = F.when(one, F.lit(i)).otherwise(number)
    pieces = max(1, -(-total[1] // (shards * slot_rows)))
    order = F.xxhash64("doc_id")
    placed = rows.select("*", number.cast("int").alias("shard"), order.alias("h"), F.pmod(order, F.lit(pieces)).alias("piece"))
    return number_slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def number_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: gapless numbers from 0 in each shard, over pieces of bounded size."""
    counts = placed.groupBy("shard", "piece").count()
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = staged(counts.select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "slot-offsets")
    inside = W.partitionBy("shard", "piece").orderBy("h", "doc_id", "h1", "h2")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "piece"]).withColumn("slot", (F.col("offset") + F.col("place")).cast("long"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))

