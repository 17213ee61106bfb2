"""Filter interaction audit: what each filter removes in every order of five filters.

Filters A to D look at one text, E asks whether the same text has a smaller
doc_id anywhere in the table. Equal texts are found by radix tries:

1. Every task inserts its whole texts into compressed tries, whose terminals hold
   the smallest doc_id, so a text leaves a task once however often it occurs.
2. Texts are range-partitioned by adaptive prefixes: 8 bytes, and eight times as many
   as long as a prefix weighs more than a region should. What is heavy as a whole
   text is salted. Each region's texts are merged in a trie of their own, and the trie
   is traversed for the smallest doc_ids; every other holder is a duplicate. Salted
   texts meet in a second, small round.
3. Failure masks of five bits are counted for each part; all 120 orders are read off
   these at most 32 cells of each part.

Defined cases: a null text is empty, and empty texts are equal to each other; a null
lang is the part ``""``; a row with a null doc_id is no duplicate and no original of
others, and has no labels; rows that share doc_id and text are no duplicates of each
other; a doc_id with several labels counts as good or toxic if one label says so; very
long texts are read whole; doc_id may be of any type that orders; further columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from .stage import staged, table
from .words import binary_column

LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: bytes that begin no code point
CONTINUATION = bytes(range(0x80, 0xC0))
WORDS_AT_ONCE = 100_000
#: bytes of texts that a task holds in a trie before it hands them on
HELD = 24 << 20
FIRST_DEPTH, DEEPER = 8, 8
LEAD = 64
SALTS = 64


class RadixTrie:
    """A compressed trie of byte strings; the terminal of a text holds its smallest id and a tag."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, None]  # edge, children by first byte, smallest id, tag
        self.held = 0

    def insert(self, text: bytes, doc_id, tag) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, doc_id, tag]
                self.held += len(text) - at + 200
                return
            if not text.startswith(child[0], at):
                child = self._split(node, child, text, at)
            node, at = child, at + len(child[0])
        if node[2] is None or doc_id < node[2]:
            node[2] = doc_id
        node[3] = tag

    def _split(self, parent: list, child: list, text: bytes, at: int) -> list:
        """Cut the edge to ``child`` where ``text`` leaves it."""
        edge = child[0]
        low, high = 1, min(len(edge), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(edge[:middle], at):
                low = middle
            else:
                high = middle - 1
        between = [edge[:low], {edge[low]: child}, None, None]
        parent[1][edge[0]], child[0] = between, edge[low:]
        self.held += 200
        return between

    def terminals(self) -> Iterator[tuple[bytes, object, object]]:
        """Every text with its smallest id and tag, in the order of the texts."""
        todo = [(self.root, b"")]
        while todo:
            (edge, children, doc_id, tag), path = todo.pop()
            path += edge
            if doc_id is not None:
                yield path, doc_id, tag
            todo += [(children[b], path) for b in sorted(children, reverse=True)]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (text first) as batches of bounded size."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += 100 + len(row[0] or b"")
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _local_tries(schema: pa.Schema, most: int):
    """Texts of a task through tries of bounded size: text, smallest doc_id, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = RadixTrie()
            for batch in batches:
                at = batch.schema.get_field_index
                for text, doc_id, h in zip(binary_column(batch, "text"), batch.column(at("doc_id")).to_pylist(), batch.column(at("h")).to_pylist(), strict=True):
                    trie.insert(text.as_py(), doc_id, h)
                    if trie.held > most:
                        yield from trie.terminals()
                        trie = RadixTrie()
            yield from trie.terminals()

        yield from _batches(rows(), schema)

    return run


def _merged_tries(schema: pa.Schema):
    """One trie for each region of the sorted rows; texts of salted regions go out whole, to be merged again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie, here = RadixTrie(), None
            for batch in batches:
                column = lambda name, b=batch: b.column(b.schema.get_field_index(name)).to_pylist()
                for text, doc_id, h, lead, region, salt in zip(*map(column, ("text", "doc_id", "h", "lead", "region", "salt")), strict=True):
                    if (lead, region, salt) != here:
                        yield from _out(trie, here)
                        trie, here = RadixTrie(), (lead, region, salt)
                    trie.insert(text, doc_id, h)
            yield from _out(trie, here)

        yield from _batches(rows(), schema)

    return run


def _out(trie: RadixTrie, region: tuple | None) -> Iterator[tuple]:
    for text, doc_id, h in trie.terminals():
        yield text if region[2] is not None else None, doc_id, h


def _regions(texts: DataFrame, least: int = 64 << 10) -> DataFrame:
    """``texts`` with lead, region and salt.

    The weight of a region is bounded by a share of the whole, so no more than 2^18
    prefixes of a depth are heavier; only their 64-bit hashes are broadcast. A prefix
    that shares the hash of a heavy one is cut longer than needed, no more.
    """
    text, size = F.col("text"), F.octet_length("text")
    total = texts.agg(F.coalesce(F.sum(size + LEAD), F.lit(0))).first()[0]
    capacity = max(total >> 18, min(total >> 12, 64 << 20), least)
    left, levels, depth = texts.select("text"), [], FIRST_DEPTH
    while True:
        weights = left.groupBy(F.xxhash64(F.substring(text, 1, depth)).alias("heavy")).agg(F.sum(size + LEAD).alias("weight"))
        heavy = staged(weights.where(F.col("weight") > capacity).select("heavy"), "trie-heavy")
        if heavy.isEmpty():
            break
        levels.append((depth, heavy))
        left = left.where(size > depth).join(F.broadcast(heavy), F.xxhash64(F.substring(text, 1, depth)) == F.col("heavy"), "left_semi")
        depth *= DEEPER
    chosen, hot, under = F.lit(depth), F.lit(False), F.lit(True)
    for i, (d, heavy) in enumerate(levels):
        texts = texts.join(F.broadcast(heavy.withColumnRenamed("heavy", f"heavy_{i}")), F.xxhash64(F.substring(text, 1, d)) == F.col(f"heavy_{i}"), "left")
        under = under & F.col(f"heavy_{i}").isNotNull()
        hot = hot | (under & (size <= d))
    for i, (d, _) in reversed(list(enumerate(levels))):
        chosen = F.when(F.col(f"heavy_{i}").isNull(), F.lit(d)).otherwise(chosen)
    prefix = text.substr(F.lit(1), chosen)
    salt = F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return texts.select("text", "doc_id", "h", F.substring(prefix, 1, LEAD).alias("lead"), F.xxhash64(prefix).alias("region"), salt.alias("salt"))


def _merge(keyed: DataFrame, schema: T.StructType) -> DataFrame:
    keys = ("lead", "region", "salt")
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_merged_tries(to_arrow_schema(schema)), schema)


def first_holders(docs: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id and h (a hash) of every text's smallest doc_id; ``docs`` has doc_id, text (binary) and h."""
    schema = T.StructType([T.StructField("text", T.BinaryType()), docs.schema["doc_id"], T.StructField("h", T.LongType())])
    texts = docs.where("doc_id is not null").select("text", "doc_id", "h")
    local = staged(texts.mapInArrow(_local_tries(to_arrow_schema(schema), held), schema), "trie-texts")
    merged = staged(_merge(_regions(local), schema), "trie-merged")
    salted = merged.where("text is not null")
    again = salted.select("*", F.substring("text", 1, LEAD).alias("lead"), F.xxhash64("text").alias("region"), F.lit(None).cast("int").alias("salt"))
    return merged.where("text is null").select("doc_id", "h").unionByName(_merge(again, schema).select("doc_id", "h"))


def text_mask(text: bytes) -> int:
    """Bits A to D of the filters that the text fails; words are taken some at a time."""
    n, distinct, rest = 0, set(), text
    while rest:
        words = rest.split(None, WORDS_AT_ONCE)
        rest = words.pop() if len(words) > WORDS_AT_ONCE else b""
        n += len(words)
        distinct.update(words)
    without = lambda some: len(text.translate(None, some))
    capitals, points = len(text) - without(CAPITALS), without(CONTINUATION)
    fails = (n < 200, 100 * len(distinct) < 50 * n, 100 * capitals > 3 * points, without(SIGNS) < len(text))
    return sum(1 << i for i, f in enumerate(fails) if f)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index
        mask = pa.array([text_mask(t.as_py()) for t in binary_column(batch, "text")], pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in ("doc_id", "h", "part")), mask], ["doc_id", "h", "part", "mask"])


def failure_masks(docs: DataFrame, labels: DataFrame, held: int = HELD) -> DataFrame:
    """part, mask, good and toxic of every row of ``docs``; each bit of mask is a filter that the text fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.coalesce("lang", F.lit("")).alias("part"))
    binary = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "h", "part")
    firsts = first_holders(binary.select("doc_id", "text", "h"), held)
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("h long, part string, mask int").fields])
    judged = staged(binary.mapInArrow(_masks, schema), "masks")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = judged.join(firsts.withColumn("first", F.lit(True)), ["doc_id", "h"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(DUPLICATE)).otherwise(0)
    return known.select("part", (F.col("mask") + copy).alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def orders_of(masks: DataFrame) -> DataFrame:
    """The audit of every part, order and step, from part, mask, good and toxic of each document."""
    count = lambda c: F.count_if(c)
    cells = staged(masks.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good").alias("good"), count("toxic").alias("toxic")), "cells")
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    stepped = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    bit = lambda letter: F.expr(f"shiftleft(1, ascii({letter}) - ascii('A'))")
    before = F.expr("aggregate(split(left(filter_order, place), ''), 0, (a, x) -> a | if(x = '', 0, shiftleft(1, ascii(x) - ascii('A'))))")
    stepped = stepped.select("*", bit("filter").alias("bit"), before.alias("before"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    audit = stepped.groupBy("part", "filter_order", (F.col("place") + 1).cast("int").alias("step"), "filter").agg(
        total("n", ~fails & ~earlier).alias("kept"), total("n", fails & ~earlier).alias("removed"), total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", fails & ~earlier).alias("good_lost"), total("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    return audit.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter"))).drop("filter")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What filters A to E keep and remove in each of their 120 orders, for each part."""
    return orders_of(failure_masks(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split_up AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT s.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         (len(ws) < 200) AS a, (100 * len(list_distinct(ws)) < 50 * len(ws)) AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(s.doc_id > min(s.doc_id) OVER (PARTITION BY t), false) AS e
  FROM split_up s LEFT JOIN marks m ON s.doc_id = m.doc_id),
cells AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS before FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
judged AS (
  SELECT c.*, s.*, contains(failed, filter) AS fails, CASE WHEN before = '' THEN false ELSE regexp_matches(failed, '[' || CASE WHEN before = '' THEN 'x' ELSE before END || ']') END AS earlier
  FROM cells c, steps s),
audit AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = filter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM audit
"""
