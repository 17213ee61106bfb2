"""Benchmark decontamination: BM25 over the test items, searched with block-max pruning.

The test items are the indexed side. An item is found by its question, which any
leak has to hold (by its answer, if the question has no words): postings by term,
cut into blocks of entries with the largest impact of the term in each block. Every document is cut into passages of ``2 L`` words every ``L``
words, L being the longest entry, so that each entry that stands in a document
stands wholly in some passage. Every passage is a query, and all entries are
retrieved whose BM25 score reaches ``threshold`` times the score of the entry for
its own text:

* the terms of a passage are ordered by their largest impact anywhere; those at
  the low end that can only give a fraction of the threshold together are not
  expanded, and a passage whose terms cannot reach it at all is left out;
* the others are expanded to blocks, and a block is left out if its largest
  impacts plus all that was not expanded stay below the threshold;
* the entries of the blocks that are left get their exact score.

A question may also stand in pieces of which no passage holds enough, or without its
rarest words. Documents therefore are looked up by shingles too: entries of which
``overlap`` of the five-word shingles stand in the document, wherever, are
retrieved beside those of the passages, with the score of the whole document, so
nothing is lost that verification would confirm.

A retrieved item counts as
leaked if at least ``overlap`` of the five-word shingles of its question and of
its answer stand in the document. The answer is the last sentence of an item, the
question what comes before; an item of one sentence is all question. A part of
fewer than five words is one shingle, a part without words counts as found. Both
parts may stand anywhere in the document, far from each other or not.

Words are split at white space and ASCII signs, A-Z lower-cased. The index is
made by Spark and broadcast in shards of at most ``SHARD_POSTINGS`` postings;
each shard scans the documents once. Nothing about documents is shuffled.

Defined cases: null and empty texts hold nothing and leak nothing; items without
words are never retrieved; equal items are each reported; repeated rows are
reported once for each (doc_id, item_id); a row with a null doc_id is searched and
reported under it; empty tables give no rows; further columns, whatever their
names, are ignored by ``leaks`` and passed on by ``without_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .stage import numbered_ids, staged, table, trimmed
from .words import SIGNS_AND_SPACE, Chunk, binary_column, chunks, gram_hashes, word_hashes

SHARD_POSTINGS = 2_000_000
BLOCK = 4
#: share of the threshold that the terms which are not expanded may give together
UNEXPANDED = 0.3
#: blocks scored, and words searched, at once: bounds the memory of a task
SLICE, STRETCH = 4_000, 50_000
K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
#: bits of a table that tells most shingles of documents from those of entries
SIEVE = 20
SENTENCE_END = re.compile(r"[.!?]\s+|\n+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: all before the last sentence, and the last sentence."""
    text = text.strip()
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(Chunk(0, 1, data, np.array([0, len(data)])), lower=True, separators=SIGNS_AND_SPACE)[0]


@trimmed
def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, items, kinds, terms, tfs, words = [], [], [], [], [], []
        for row, item, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for kind, part in enumerate(split_item(text or "")):
                own = _hashes(part)
                if len(own):
                    term, tf = np.unique(own, return_counts=True)
                    rows.append(row)
                    items.append(item)
                    kinds.append(kind)
                    terms.append(term.view(np.int64))
                    tfs.append(tf)
                    words.append(own.view(np.int64))
        lists = pa.list_(pa.int64())
        columns = [pa.array(rows, pa.int64()), pa.array(items, pa.int64()), pa.array(kinds, pa.int32()), pa.array(terms, lists), pa.array(tfs, lists), pa.array(words, lists)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "item_id", "kind", "terms", "tfs", "words"])


#: one row for each part of an item that has words; kind is 0 for the question and 1 for the answer
PART_SCHEMA = "row long, item_id long, kind int, terms array<long>, tfs array<long>, words array<long>"


class Index(NamedTuple):
    """One shard. Terms are numbered by rising largest impact; impacts are shares of an entry's score for its own text.

    Entries are the parts of items in the order of the items, of which the first has
    postings; ``grams`` are their five-word shingles, in entries ``gram_entries`` from ``gram_from`` on, ``gram_counts`` for each entry; ``items`` says of each to which item it belongs, ``first`` where the
    entries of an item begin.
    """

    vocabulary: np.ndarray
    number: np.ndarray
    largest: np.ndarray
    block_from: np.ndarray
    blocks: np.ndarray
    block_impact: np.ndarray
    entry_from: np.ndarray
    entry_terms: np.ndarray
    entry_impact: np.ndarray
    items: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    kinds: np.ndarray
    words: list[np.ndarray]
    span: int
    grams: np.ndarray
    gram_from: np.ndarray
    gram_entries: np.ndarray
    gram_counts: np.ndarray
    sieve: np.ndarray


def build_index(rows: np.ndarray, ids: np.ndarray, kinds: np.ndarray, terms: list[np.ndarray], impacts: list[np.ndarray], words: list[np.ndarray]) -> Index:
    sizes = np.array([len(t) for t in terms])
    flat, weight = np.concatenate(terms), np.concatenate(impacts)
    vocabulary, at = np.unique(flat, return_inverse=True)
    largest = np.zeros(len(vocabulary))
    np.maximum.at(largest, at, weight)
    order = np.argsort(largest, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    term = number[at]
    block = np.repeat(np.arange(len(rows)) // BLOCK, sizes)
    blocks_in_all = int(block[-1]) + 1
    pairs, where = np.unique(term * blocks_in_all + block, return_inverse=True)
    block_impact = np.zeros(len(pairs))
    np.maximum.at(block_impact, where, weight)
    block_from = np.searchsorted(pairs // blocks_in_all, np.arange(len(vocabulary) + 1))
    new = np.concatenate([[True], rows[1:] != rows[:-1]])
    first = np.flatnonzero(new)
    # entries that are found (those with postings) and are no shorter than a shingle
    own = [np.unique(gram_hashes(w, SHINGLE)) if n and len(w) >= SHINGLE else np.zeros(0, np.uint64) for w, n in zip(words, sizes, strict=True)]
    gram_counts = np.array([len(x) for x in own])
    every, holder = np.concatenate(own), np.repeat(np.arange(len(own)), gram_counts)
    by = np.argsort(every, kind="stable")
    grams, gram_from = np.unique(every[by], return_index=True)
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[(grams >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
    return Index(vocabulary, number, largest[order], block_from, pairs % blocks_in_all, block_impact, np.concatenate([[0], np.cumsum(sizes)]), term, weight, np.cumsum(new) - 1, np.append(first, len(rows)), ids[first], kinds, words, max(map(len, words)), grams, np.append(gram_from, len(every)), holder[by], gram_counts, sieve)


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers from each start to its end, and which range each came from."""
    n = ends - starts
    origin = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[origin], origin


def retrieve(index: Index, hashes: np.ndarray, rows: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, entry and score of all passages of the rows that reach the threshold for an entry.

    ``hashes`` are the words of the rows, those of row i from ``rows[i]`` to ``rows[i + 1]``.
    """
    none = np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    place = np.flatnonzero(index.vocabulary[at] == hashes)
    if not len(place):
        return none, none, np.zeros(0)
    term = index.number[at[place]]
    row = np.searchsorted(rows, place, side="right") - 1
    step = max(index.span, 1)
    pieces = np.maximum(1, -(-np.diff(rows) // step))
    first = np.cumsum(pieces) - pieces
    piece = (place - rows[row]) // step
    # passage k of a row holds its pieces k and k + 1
    passage = np.concatenate([first[row] + piece, (first[row] + piece - 1)[piece > 0]])
    key = np.unique(passage * len(index.vocabulary) + np.concatenate([term, term[piece > 0]]))
    passage, term = np.divmod(key, len(index.vocabulary))
    gained = np.cumsum(index.largest[term])
    begins = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    group = np.cumsum(np.concatenate([[True], passage[1:] != passage[:-1]])) - 1
    base = np.concatenate([[0.0], gained])[begins]
    reach = gained - base[group]  # of the terms so far, the most that they can give together
    essential = reach >= threshold * UNEXPANDED
    ends = np.append(begins[1:], len(key)) - 1
    hopeful = reach[ends] >= threshold - 1e-9
    unexpanded = np.zeros(len(begins))
    np.maximum.at(unexpanded, group[~essential], reach[~essential])
    chosen = np.flatnonzero(essential & hopeful[group])
    if not len(chosen):
        return none, none, np.zeros(0)
    entry, origin = _expand(index.block_from[term[chosen]], index.block_from[term[chosen] + 1])
    n_blocks = int(index.blocks.max()) + 1
    pair, where = np.unique(group[chosen][origin] * n_blocks + index.blocks[entry], return_inverse=True)
    bound = np.bincount(where, index.block_impact[entry], len(pair)) + unexpanded[pair // n_blocks]
    group_left, block_left = np.divmod(pair[bound >= threshold - 1e-9], n_blocks)
    out = []
    for cut in range(0, len(block_left), SLICE):
        blocks = block_left[cut : cut + SLICE]
        entry, origin = _expand(blocks * BLOCK, np.minimum((blocks + 1) * BLOCK, len(index.items)))
        passage_of = passage[begins][group_left[cut : cut + SLICE][origin]]
        post, origin = _expand(index.entry_from[entry], index.entry_from[entry + 1])
        wanted = passage_of[origin] * len(index.vocabulary) + index.entry_terms[post]
        spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        score = np.bincount(origin, np.where(key[spot] == wanted, index.entry_impact[post], 0.0), len(entry))
        hit = score >= threshold - 1e-9
        out.append((np.searchsorted(first, passage_of[hit], side="right") - 1, entry[hit], score[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, np.zeros(0))


def by_shingles(index: Index, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and entry of all entries of which ``OVERLAP`` of the shingles stand in a row."""
    none = np.zeros(0, np.int64)
    if len(hashes) < SHINGLE or not len(index.grams):
        return none, none
    grams = gram_hashes(hashes, SHINGLE)
    at = np.flatnonzero(index.sieve[(grams >> np.uint64(64 - SIEVE)).astype(np.int64)])
    row = np.searchsorted(rows, at, side="right") - 1
    at, row = at[at + SHINGLE <= rows[row + 1]], row[at + SHINGLE <= rows[row + 1]]
    spot = np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)
    known = index.grams[spot] == grams[at]
    row, spot = np.divmod(np.unique(row[known] * len(index.grams) + spot[known]), len(index.grams))
    place, origin = _expand(index.gram_from[spot], index.gram_from[spot + 1])
    pairs, hits = np.unique(row[origin] * len(index.gram_counts) + index.gram_entries[place], return_counts=True)
    row, entry = np.divmod(pairs, len(index.gram_counts))
    enough = hits >= OVERLAP * index.gram_counts[entry] - 1e-9
    return row[enough], entry[enough]


def part_overlap(part: np.ndarray, document: np.ndarray, cache: dict[int, np.ndarray]) -> tuple[int, int]:
    """How many distinct shingles the part has, and how many stand in the document."""
    if not len(part):
        return 0, 0
    n = min(SHINGLE, len(part))
    if n not in cache:
        cache[n] = np.unique(gram_hashes(document, n))
    own = np.unique(gram_hashes(part, n))
    return len(own), int(np.isin(own, cache[n], assume_unique=True).sum())


def _stretches(rows: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of rows of at most ``STRETCH`` words: the first row and the borders. A longer row comes in
    stretches of its own that overlap by two spans, so that no passage is lost."""
    i, n = 0, len(rows) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(rows, rows[i] + STRETCH, side="right")) - 1)
        if rows[j] - rows[i] <= STRETCH:
            yield i, rows[i : j + 1]
        else:
            for start in range(int(rows[i]), int(rows[j]), STRETCH):
                yield i, np.array([start, min(start + STRETCH + 2 * span, int(rows[j]))])
        i = j


def _search(index: Index, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """Row, item number, score, question overlap and answer overlap of verified leaks."""
    best: dict[tuple[int, int], dict[int, float]] = {}
    for first, borders in _stretches(rows, index.span):
        row, entry, score = retrieve(index, hashes[borders[0] : borders[-1]], borders - borders[0])
        for r, i, e, s in zip((row + first).tolist(), index.items[entry].tolist(), entry.tolist(), score.tolist(), strict=True):
            parts = best.setdefault((r, i), {})
            parts[e] = max(s, parts.get(e, 0.0))
    for r, e in zip(*(x.tolist() for x in by_shingles(index, hashes, rows)), strict=True):
        if e not in best.get((r, int(index.items[e])), {}):
            post = slice(index.entry_from[e], index.entry_from[e + 1])
            terms = np.isin(index.vocabulary[np.argsort(index.number)[index.entry_terms[post]]], hashes[rows[r] : rows[r + 1]])
            best.setdefault((r, int(index.items[e])), {})[e] = float(index.entry_impact[post][terms].sum())
    cache: dict[int, np.ndarray] = {}
    last = -1
    for (r, i), parts in sorted(best.items()):
        entries = range(index.first[i], index.first[i + 1])
        if r != last:
            cache, last = {}, r
        own = hashes[rows[r] : rows[r + 1]]
        shares = [1.0, 1.0]
        for e in entries:
            n, hit = part_overlap(index.words[e], own, cache)
            shares[index.kinds[e]] = hit / n
        if min(shares) >= OVERLAP:
            yield r, i, min(parts.values()), *shares


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))])
    arrow = to_arrow_schema(schema)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = shared.value
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            out: list[tuple] = []
            for chunk in chunks(binary_column(batch, "text")):
                hashes, w = word_hashes(chunk, lower=True, separators=SIGNS_AND_SPACE)
                out += [(ids[chunk.start + r], int(index.ids[i]), *rest) for r, i, *rest in _search(index, hashes, w.rows)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def indexes(items: DataFrame, postings: int = SHARD_POSTINGS) -> Iterator[Index]:
    """The items (item_id as long, text) as indexes of about ``postings`` postings, one at a time; df and lengths are of all of them."""
    numbered = staged(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("row", F.monotonically_increasing_id()), "items")
    rows = staged(numbered.select("row", "item_id", "text").mapInArrow(_item_rows, PART_SCHEMA).withColumn("size", F.size("words")), "item-parts")
    # the parts by which items are found; df and lengths are of these
    leading = rows.join(rows.groupBy("row").agg(F.min("kind").alias("kind")), ["row", "kind"])
    n, mean, total = leading.agg(F.count("*"), F.avg("size"), F.sum(F.size("terms"))).first()
    if not n:
        return
    posts = leading.select("row", "kind", "size", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", "kind", "size", "p.terms", "p.tfs")
    df = posts.groupBy("terms").agg(F.count("*").alias("df"))
    tf = F.col("tfs") * (K1 + 1) / (F.col("tfs") + K1 * (1 - B + B * F.col("size") / mean))
    weighed = posts.join(df, "terms").select("row", "kind", "terms", (F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf).alias("weight"))
    share = weighed.select("row", "kind", "terms", (F.col("weight") / F.sum("weight").over(W.partitionBy("row", "kind"))).alias("impact"))
    lists = share.groupBy("row", "kind").agg(F.sort_array(F.collect_list(F.struct("terms", "impact"))).alias("posts"))
    none = F.array().cast(lists.schema["posts"].dataType)
    full = staged(rows.select("row", "kind", "item_id", "words").join(lists, ["row", "kind"], "left").withColumn("posts", F.coalesce("posts", none)), "index")
    shards = max(1, -(-int(total) // postings))
    for k in range(shards):
        found = full.where(F.pmod(F.xxhash64("row"), F.lit(shards)) == k).toArrow().sort_by([("row", "ascending"), ("kind", "ascending")])
        if found.num_rows:
            posts_of = [x.values.flatten() for x in found["posts"]]
            words = [x.values.to_numpy().view(np.uint64) for x in found["words"]]
            numbers = [found[c].fill_null(-1).to_numpy() for c in ("row", "item_id", "kind")]
            yield build_index(*numbers, [p[0].to_numpy().view(np.uint64) for p in posts_of], [p[1].to_numpy() for p in posts_of], words)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that leaked into it, with score and overlaps."""
    found: DataFrame | None = None
    items, back = numbered_ids(items.select("item_id", "text"), "item_id")
    for index in indexes(items):
        part = _scan(docs, index)
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), *(F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap"))).where("false")
        return back(empty, "item_id")
    return back(found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap"))), "item_id")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents into which an item leaked; rows without a doc_id stay."""
    marked = staged(leaks(docs, items).select(F.col("doc_id").alias("__leaked")).distinct(), "leaked")
    return docs.hint("merge").join(marked, F.col("doc_id") == F.col("__leaked"), "left_anti")


def op10_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("score")


#: the verified overlaps alone, of every document with every item
ORACLE = r"""
WITH cut AS (SELECT item_id, trim(text) AS text, regexp_extract(trim(text), '^(?s:.*)(?:[.!?]\s+|\n+)') AS question FROM benchmark),
halves AS (SELECT item_id, 'q' AS part, CASE WHEN question = '' THEN text ELSE question END AS text FROM cut UNION ALL SELECT item_id, 'a', substr(text, length(question) + 1) FROM cut WHERE question <> ''),
parts AS (SELECT item_id, part, w, least(5, len(w)) AS n FROM (
  SELECT item_id, part, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM halves) WHERE len(w) > 0),
own AS (SELECT DISTINCT item_id, part, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM parts)),
total AS (SELECT item_id, part, count(*) AS t FROM own GROUP BY ALL),
docs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM parts) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, part, count(*) AS h FROM grams JOIN own USING (n, g) GROUP BY ALL),
shares AS (SELECT doc_id, item_id, part, h / t AS share FROM hits JOIN total USING (item_id, part))
SELECT q.doc_id, q.item_id, q.share AS question_overlap, coalesce(a.share, 1.0) AS answer_overlap
FROM (SELECT * FROM shares WHERE part = 'q') q LEFT JOIN (SELECT * FROM shares WHERE part = 'a') a USING (doc_id, item_id)
WHERE q.share >= 0.8 AND (a.share >= 0.8 OR NOT EXISTS (SELECT 1 FROM total t WHERE t.item_id = q.item_id AND t.part = 'a'))
"""
