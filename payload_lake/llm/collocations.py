"""Phrase collocations of each language, counted in counting quotient filters.

1. Words are counted exactly by language. A word's id is a run of bits of a 64-bit hash
   of language and word; the run is taken where no frequent word shares its id with
   another word of the corpus, which is tested on all distinct words.
2. Two-word, then three-word n-grams of ids are packed, permuted invertibly and
   counted in counting quotient filters (see ``quotient_filter``). A task hands out
   one filter for each slice of keys and pack of words; sorted filters of a slice
   are merged across packs, in several rounds of bounded fan-in where a corpus needs more
   slices than a pack can be cut into. N-grams whose parts are not frequent
   cannot be frequent themselves; a bit table of fixed size keeps most of them out.
3. What is frequent is joined with the counts of its parts, scored in exact decimals,
   and dropped where a longer candidate holds it nearly as often.

Defined cases: a null text is empty; a null lang is ``und``; rows count each, repeated
or not, and doc_id is not used; very long texts are read whole, in chunks of whole
rows; bytes that are no UTF-8 are parts of words as they are; ties follow the phrase's
bytes; counts up to 10^12 are exact; further columns are not read; an empty table
gives no rows. A language whose words all are rare gives none either.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from . import quotient_filter as qf
from .stage import staged, table
from .words import SPACE, U64, Chunk, binary_column, chunks, mix, word_hashes

#: characters at which a text is cut into pieces, and all that stand between words
BREAKS = b".,;:!?\n\x0b\x0c\r"
_IS_BREAK = np.isin(np.arange(256), np.frombuffer(BREAKS, np.uint8))
_BETWEEN = SPACE | _IS_BREAK
_TO_SPACE = bytes.maketrans(BREAKS + b"\t", b" " * (len(BREAKS) + 1))
#: n-grams that a task sorts together, and distinct words that it counts together
PACK, WORDS_HELD = 1 << 21, 300_000
#: entries of a slice when all packs are merged; leading bits by which packs are cut, first and with each round of merging; filters merged at once
SLICE, FIRST_BITS, MORE_BITS, FAN_IN = 1 << 19, 10, 6, 64
#: (bits of an id, bits above it) in the order in which they are tried
IDS = ((42, 0), (42, 22), (42, 11), (64, 0))
TABLE_BITS = 26


def _lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) | 1


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, h (hash of both) and n of the words of a task, counted in packs."""
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            words = list(counts)
            for low in range(0, len(words), 50_000):
                some = words[low : low + 50_000]
                body = np.frombuffer(b" ".join(some), np.uint8)
                hashes, _ = word_hashes(Chunk(0, 1, body, np.array([0, len(body)])), lower=True, separators=_BETWEEN)
                h = mix(hashes + U64(_lang_hash(lang))).view(np.int64)
                n = pa.array([counts[w] for w in some], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array(h), n], ["lang", "word", "h", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), binary_column(batch, "text"), strict=True):
            held.setdefault(lang, Counter()).update(text.as_py().lower().translate(_TO_SPACE).split())
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from out()
                held = {}
    yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (bytes), h and f of every distinct word of ``docs`` (lang, text)."""
    counted = docs.mapInArrow(_counted_words, "lang string, word binary, h long, n long")
    return counted.groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("n").alias("f"))


def word_id(h: Column, width: int, above: int) -> Column:
    """``width`` bits of a hash, from ``above`` bits below its top."""
    return h if width == 64 else F.shiftrightunsigned(F.shiftleft(h, above), 64 - width)


def chosen_ids(words: DataFrame, least: int, ids=IDS) -> tuple[int, int]:
    """The first (width, above) by which no word of ``least`` or more shares its id with another."""
    for width, above in ids:
        shared = words.groupBy(word_id(F.col("h"), width, above).alias("id")).agg(F.count("*").alias("n"), F.max("f").alias("f"))
        if shared.where((F.col("n") > 1) & (F.col("f") >= least)).isEmpty():
            return width, above
    raise ValueError("words share their 64-bit hashes")


def bit_table(leading: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """A table of ``2 ** bits`` bits, set at the leading bits of the column ``lane``; at most ``2 ** (bits - 6)`` rows come to the driver."""
    slot = F.shiftrightunsigned("lane", 64 - bits)
    mask = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = leading.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("mask").to_numpy()
    return out.view(np.uint64)


def _in_table(lane: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = lane >> U64(64 - (len(table).bit_length() + 5))
    return (table[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1


def _ids_of(chunk: Chunk, langs: np.ndarray, width: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of a chunk, and which words follow on the one before them within a piece."""
    hashes, w = word_hashes(chunk, lower=True, separators=_BETWEEN)
    per_row = np.diff(w.rows)
    ids = mix(hashes + np.repeat(langs, per_row))
    ids = ids << U64(above) >> U64(64 - width)
    pieces = np.concatenate([np.zeros(1, np.int64), np.cumsum(_IS_BREAK[chunk.data])])[w.starts]
    row = np.repeat(np.arange(len(per_row)), per_row)
    follows = np.zeros(len(ids), bool)
    follows[1:] = (pieces[1:] == pieces[:-1]) & (row[1:] == row[:-1])
    return ids, follows


def _grams(ids: np.ndarray, follows: np.ndarray, n: int, width: int, table: np.ndarray) -> qf.Lanes:
    """Permuted keys of the n-grams of which both parts of n - 1 words are in the table."""
    at = np.flatnonzero(follows)
    if n == 2:
        known = _in_table(ids << U64(64 - width), table)
        at = at[known[at] & known[at - 1]]
        return qf.permute(qf.pack([ids[at - 1], ids[at]], width), 2, width)
    known = np.zeros(len(ids), bool)
    known[at] = _in_table(qf.permute(qf.pack([ids[at - 1], ids[at]], width), 2, width)[0], table)
    at = at[known[at] & known[at - 1]]
    return qf.permute(qf.pack([ids[at - 2], ids[at - 1], ids[at]], width), 3, width)


FILTERS = "slice int, pack long, filter binary"


def _filters(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, pack, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(pack, pa.int64()), pa.array(body, pa.binary())], ["slice", "pack", "filter"])


def _counted_grams(n: int, width: int, above: int, known, bits: int, most: int):
    """Filters of the n-grams of a task, one for each slice and pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = known.value, [], 0
        pack = TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = qf.summed([np.concatenate(x) for x in zip(*held, strict=True)])
            rows = []
            for part, body in qf.slices(keys, counts, bits, n, width):
                rows.append((part, pack, body))
                if len(rows) == 256:
                    yield _filters(rows)
                    rows = []
            if rows:
                yield _filters(rows)

        for batch in batches:
            langs = np.array([_lang_hash(x) for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.uint64)
            for chunk in chunks(binary_column(batch, "text")):
                lanes = _grams(*_ids_of(chunk, langs[chunk.start : chunk.stop], width, above), n, width, table)
                if len(lanes[0]):
                    held.append(lanes)
                    size += len(lanes[0])
                if size >= most:
                    yield from out()
                    held, size, pack = [], 0, pack + 1
        if held:
            yield from out()

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """The filters of each (slice, pack) of sorted rows."""
    here, held = None, []
    for batch in batches:
        column = lambda name, b=batch: b.column(b.schema.get_field_index(name)).to_pylist()
        for part, pack, body in zip(*map(column, ("slice", "pack", "filter")), strict=True):
            if (part, pack) != here:
                if held:
                    yield (*here, held)
                here, held = (part, pack), []
            held.append(body)
    if held:
        yield (*here, held)


def _merged(n: int, width: int, bits: int):
    """The filters of each slice and pack as one, cut into slices of ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pack, bodies in _by_key(batches):
            keys, counts = qf.merge(bodies, part, n, width)
            yield _filters([(p, pack, body) for p, body in qf.slices(keys, counts, bits, n, width)])

    return run


def _frequent(n: int, width: int, least: int, schema: pa.Schema):
    """Keys of ``least`` or more of each slice, as ids again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, bodies in _by_key(batches):
            keys, counts = qf.merge(bodies, part, n, width)
            keep = counts >= least
            keys = [x[keep] for x in keys]
            ids = qf.unpack(qf.restore(keys, n, width), n, width)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys[0], *ids)] + [pa.array(counts[keep])], schema=schema)

    return run


def frequent_grams(docs: DataFrame, n: int, width: int, above: int, known: np.ndarray, words: int, least: int) -> DataFrame:
    """lane (the first of the key), k0 to k(n-1) and a of all n-grams found ``least`` times; ``words`` is the number of all words."""
    spark = docs.sparkSession
    last = max(6, (words // SLICE).bit_length())
    bits = min(last, FIRST_BITS)
    shared = spark.sparkContext.broadcast(known)
    filters = docs.mapInArrow(_counted_grams(n, width, above, shared, bits, PACK), FILTERS)
    if bits < last:
        filters = staged(filters, "filters")
        packs = filters.select("pack").distinct().count()
        while bits < last:
            bits, packs = min(bits + MORE_BITS, last), -(-packs // FAN_IN)
            grouped = filters.withColumn("pack", F.pmod(F.xxhash64("pack"), F.lit(packs))).repartition("slice", "pack").sortWithinPartitions("slice", "pack")
            filters = staged(grouped.mapInArrow(_merged(n, width, bits), FILTERS), "filters")
    whole = filters.withColumn("pack", F.lit(0).cast("long")).repartition("slice").sortWithinPartitions("slice")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("lane", *(f"k{i}" for i in range(n)), "a")])
    out = staged(whole.mapInArrow(_frequent(n, width, least, to_arrow_schema(schema)), schema), f"grams-{n}")
    shared.unpersist()
    return out


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) of columns, exact beyond 64 bits."""
    number = lambda c: f"cast({c} as decimal(13, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({number(a)} * {number(a)})) div ({number(left)} * {number(right)})")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases of two or three words found ``least`` times, by score, count and bytes.

    ``docs`` has text and lang. A phrase is dropped if a longer one of ``least`` or
    more that holds it is found in ``share`` percent of its places or more.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    every = staged(word_counts(docs), "words")
    sizes = staged(every.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width, above = chosen_ids(every, least)
    words = staged(every.where(F.col("f") >= least).select("lang", "word", "f", word_id(F.col("h"), width, above).alias("id")), "frequent-words")
    known = bit_table(words.select(F.shiftleft("id", 64 - width).alias("lane")))
    pairs = frequent_grams(docs, 2, width, above, known, total, least)
    side = lambda i: words.select(F.col("id").alias(f"k{i}"), F.col("lang").alias(f"lang{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"))
    space = F.lit(b" ")
    pairs = staged(
        pairs.join(side(0), "k0").join(side(1), "k1").where("lang0 = lang1")
        .select("k0", "k1", "lane", "a", F.col("lang0").alias("lang"), "word1", F.concat("word0", space, "word1").alias("phrase"), "f0", "f1"), "pairs",
    )
    triples = frequent_grams(docs, 3, width, above, bit_table(pairs.select("lane")), total, least)
    ahead = pairs.select("k0", "k1", "lang", F.col("phrase").alias("head"), F.col("f0").alias("l1"), F.col("a").alias("l2"))
    behind = pairs.select(F.col("k0").alias("k1"), F.col("k1").alias("k2"), F.col("word1").alias("tail"), F.col("a").alias("r1"), F.col("f1").alias("r2"))
    triples = staged(triples.join(ahead, ["k0", "k1"]).join(behind, ["k1", "k2"]).select("*", score("a", "l1", "r1").alias("s1"), score("a", "l2", "r2").alias("s2")), "triples")
    second = F.col("s2") < F.col("s1")
    either = lambda x: F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias("score" if x == "s" else x)
    long = triples.select("lang", F.concat("head", space, "tail").alias("phrase"), "a", either("l"), either("r"), either("s"))
    parts = triples.select(F.col("a").alias("longer"), F.explode(F.array(F.struct("k0", "k1"), F.struct(F.col("k1").alias("k0"), F.col("k2").alias("k1")))).alias("p"))
    held = parts.select("longer", "p.k0", "p.k1").groupBy("k0", "k1").agg(F.max("longer").alias("longer"))
    alone = pairs.join(held, ["k0", "k1"], "left").where(F.expr(f"longer is null or 100 * longer < {share} * a"))
    short = alone.select("lang", "phrase", "a", F.col("f0").alias("l"), F.col("f1").alias("r"), score("a", "f0", "f1").alias("score"))
    return ranked(short.unionByName(long), top).join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "lang").select(
        "lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score"
    )


def ranked(phrases: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` of each language with their rank: first of parts of the language, then of what these leave."""
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", place("lang", "salt")).where(F.col("rank") <= top)
    return first.withColumn("rank", place("lang")).where(F.col("rank") <= top).drop("salt")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
words AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM pieces) GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM words GROUP BY lang),
pairs AS (
  SELECT lang, w1, w2, count(*) AS a FROM (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM pieces))
  GROUP BY ALL HAVING count(*) >= 10),
triples AS (
  SELECT lang, w1, w2, w3, count(*) AS a FROM (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM pieces))
  GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.a, 1 AS k, x.f AS l, y.a AS r
  FROM triples t JOIN words x ON x.lang = t.lang AND x.w = t.w1 JOIN pairs y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 2, x.a, y.f
  FROM triples t JOIN pairs x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN words y ON y.lang = t.lang AND y.w = t.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2, p.a, 1, x.f, y.f
  FROM pairs p JOIN words x ON x.lang = p.lang AND x.w = p.w1 JOIN words y ON y.lang = p.lang AND y.w = p.w2
  WHERE NOT EXISTS (SELECT 1 FROM triples t WHERE t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 AND 100 * t.a >= 50 * p.a)
    AND NOT EXISTS (SELECT 1 FROM triples t WHERE t.lang = p.lang AND t.w2 = p.w1 AND t.w3 = p.w2 AND 100 * t.a >= 50 * p.a)),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN sizes USING (lang)
WHERE rank <= 2000
"""
