"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put in an order that keeps alike ones together (nearest of a few
centroids, then id) and cut into ranges of at most ``BLOCK``. One row of the index
is one block: its forward index (ids and whole vectors) and, for each component
(the "term"), its largest and smallest value. For a query, the sum over components
of the larger of ``q * high`` and ``q * low`` bounds every score in the block.

Queries are taken in batches of bounded size, which are broadcast. For a batch,

1. every task scores, of each group of blocks, the block with the best bound of each
   query; the best k-th entry over all tasks is the query's threshold;
2. every task takes the blocks in the order of their bounds, query by query, in
   rounds of doubling length, and scores them through the forward index until the
   next bound falls below the k-th entry (the threshold, or what the task has found).
   At most k entries for each query leave a task.

The order and the centroids (of a bounded sample) only decide how much is pruned;
every vector is indexed and the result is exact.

Defined cases: vectors that are null or hold null or non-finite components, and rows
with a null id, take no part; shorter vectors count as filled up with zeros (an empty
one scores 0); rows that share the query's id are its own and are no candidates;
other repeated rows are candidates each; a query id with several rows asks with the
least of its vectors; ties go to the smaller id; products are exact, a score
outside of 64 bits raises; components beyond 2^53 are clipped to 64 bits; further
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stage import staged, table

SCALE = 1024
BLOCK = 256
#: blocks that a task looks at together
GROUP = 64
#: vectors from which the centroids of the order are learned, and how many there are at most
SAMPLE, CENTROIDS = 4096, 256
#: bytes of the queries that are broadcast together
BATCH_BYTES = 16 << 20
EXACT = 1 << 53
LEAST = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def quantised(x: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) as longs; null if the vector takes no part."""
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(sound, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` longs, filled up with zeros."""
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def centroids(vectors: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Lloyd's rounds from evenly spaced starts."""
    x = vectors.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=n)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _assign(centres, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            ids, lists = batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index("v"))
            near = np.argmax(matrix(lists, dims) @ c.T - (c**2).sum(1) / 2, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(near)], ["vec_id", "v", "near"])

    return run


BLOCK_SCHEMA = "ids binary, vectors binary, width int, high binary, low binary"


def _block(ids: list[np.ndarray], rows: list[np.ndarray]) -> tuple:
    x = np.concatenate(rows)
    high, low = x.max(axis=0), x.min(axis=0)
    width = next(w for w in (2, 4, 8) if w == 8 or high.max(initial=0) < 1 << 8 * w - 1 and low.min(initial=0) >= -(1 << 8 * w - 1))
    return np.concatenate(ids).astype("<i8").tobytes(), x.astype(f"<i{width}").tobytes(), width, high.astype("<i8").tobytes(), low.astype("<i8").tobytes()


def _pack(dims: int, block: int):
    """Consecutive rows as blocks that end where the centroid changes."""
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        here, held = None, 0
        for batch in batches:
            at = batch.schema.get_field_index
            own, near, x = batch.column(at("vec_id")).to_numpy(), batch.column(at("near")).to_numpy(), matrix(batch.column(at("v")), dims)
            begin, out = 0, []
            while begin < len(own):
                end = begin + int(np.searchsorted(near[begin:], near[begin], side="right"))
                if held and (near[begin] != here or held == block):
                    out.append(_block(ids, rows))
                    ids, rows, held = [], [], 0
                end = min(end, begin + block - held)
                ids.append(own[begin:end])
                rows.append(x[begin:end])
                here, held, begin = near[begin], held + end - begin, end
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), schema=_BLOCKS)
        if held:
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, _block(ids, rows), strict=True)}, schema=_BLOCKS)

    return run


_BLOCKS = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("high", pa.binary()), ("low", pa.binary())])


class Best:
    """The k best entries of each query so far: higher score first, smaller id among equals."""

    def __init__(self, k: int, score: np.ndarray, last: np.ndarray) -> None:
        """``score`` and ``last`` are an entry for each query that the k-th best reaches at least."""
        self.k, self.score, self.last = k, score.copy(), last.copy()
        self.entries = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Take in (query, score, id) entries and raise the k-th entries."""
        query, score, ids = (np.concatenate(c) for c in zip(self.entries, *found, strict=True))
        order = np.lexsort((ids, ~score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        at, better = query[full], (score[full] > self.score[query[full]]) | ((score[full] == self.score[query[full]]) & (ids[full] < self.last[query[full]]))
        self.score[at[better]], self.last[at[better]] = score[full][better], ids[full][better]
        keep = place < self.k
        self.entries = query[keep], score[keep], ids[keep]


class BlockSearch:
    """The search of one batch of queries through groups of blocks."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
        self.ids, self.best, self.exact = ids, best, queries
        self.fast = queries.astype(np.float64)
        self.largest = int(np.abs(self.fast).max(initial=0)) + 1
        self.scored = self.seen = 0

    def _numbers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and ``x`` in a form in which inner products are exact: floats while all sums stay below 2^53."""
        if (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) * self.largest * max(1, x.shape[1]) < EXACT:
            return self.fast, x.astype(np.float64)
        return self.exact.astype(object), x.astype(object)

    def bounds(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """For each query and block: the sum over components of the larger product."""
        q, both = self._numbers(np.concatenate([high, low]))
        high, low = both[: len(high)], both[len(high) :]
        return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T

    def score(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries of one block for some queries that reach their k-th entries."""
        out = []
        for low in range(0, len(queries), 4096):
            some = queries[low : low + 4096]
            q, x = self._numbers(vectors)
            scores = (q[some] @ x.T).astype(np.int64)
            least, last = self.best.score[some, None], self.best.last[some, None]
            keep = ((scores > least) | ((scores == least) & (ids <= last))) & (ids != self.ids[some, None])
            row, column = np.nonzero(keep)
            out.append((some[row], scores[row, column], ids[column]))
        self.scored += len(queries)
        return out

    def group(self, blocks: list[dict], most: int | None = None) -> None:
        """Blocks in the order of each query's bounds until these fall below its k-th entry; ``most``: so many blocks at most."""
        ids = [np.frombuffer(b["ids"], "<i8") for b in blocks]
        vectors = [np.frombuffer(b["vectors"], f"<i{b['width']}").reshape(len(i), -1).astype(np.int64) for b, i in zip(blocks, ids, strict=True)]
        bounds = self.bounds(*(np.stack([np.frombuffer(b[x], "<i8") for b in blocks]) for x in ("high", "low")))
        first = np.array([i.min() for i in ids])
        order = np.argsort(-bounds, axis=1, kind="stable")
        self.seen += bounds.size
        done, step, left = 0, 1, np.arange(len(self.ids))
        while done < min(len(blocks), most or len(blocks)) and len(left):
            taken = order[left, done : done + step]
            bound = np.take_along_axis(bounds[left], taken, axis=1)
            least = self.best.score[left, None]
            worth = (bound > least) | ((bound == least) & (first[taken] <= self.best.last[left, None]))
            row, column = np.nonzero(worth)
            block, query = taken[row, column], left[row]
            by_block = np.argsort(block, kind="stable")
            block, query = block[by_block], query[by_block]
            found = []
            for b in np.unique(block):
                found += self.score(query[np.searchsorted(block, b) : np.searchsorted(block, b, side="right")], ids[b], vectors[b])
            if found:
                self.best.add(found)
            left = left[(bound[:, -1:] >= least).any(axis=1)]
            done, step = done + step, step * 2 if most is None else 1


def _groups(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            if len(held) == group:
                yield held
                held = []
    if held:
        yield held


def _thresholds(batch, k: int, group: int):
    """The k-th entry of each query in the best block of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = batch.value
        nothing = np.full(len(ids), LEAST), np.full(len(ids), LAST)
        search = BlockSearch(ids, queries, Best(k, *nothing))
        for blocks in _groups(batches, group):
            search.group(blocks, most=1)
        found = np.flatnonzero(search.best.score > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, search.best.score[found], ~search.best.last[found])], ["query", "score", "last"])

    return run


def _search(batch, thresholds, k: int, group: int):
    """At most k entries of each query that reach its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = batch.value
        search = BlockSearch(ids, queries, Best(k, *thresholds.value))
        for blocks in _groups(batches, group):
            search.group(blocks)
        query, score, own = search.best.entries
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[query], own, score)], ["query_id", "vec_id", "score"])

    return run


def index(vectors: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """The blocks of ``vectors`` (vec_id, v): one row each, see ``BLOCK_SCHEMA``."""
    spark = vectors.sparkSession
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    known = matrix(sample.column("v").combine_chunks(), dims) if n else np.zeros((1, dims), np.int64)
    centres = spark.sparkContext.broadcast(centroids(known, max(1, min(CENTROIDS, n // (4 * block), len(known)))))
    near = staged(vectors.mapInArrow(_assign(centres, dims), "vec_id long, v array<long>, near int"), "near")
    blocks = near.repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id").mapInArrow(_pack(dims, block), BLOCK_SCHEMA)
    return staged(blocks, "blocks")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, group: int = GROUP, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best; ``vectors`` has vec_id (integer) and v (longs, null: no part)."""
    spark, context = vectors.sparkSession, vectors.sparkSession.sparkContext
    vectors = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where("vec_id is not null and v is not null"), "vectors")
    dims = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    blocks = index(vectors, dims, block)
    queries = staged(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    batches = -(-queries.count() * max(1, dims) * 8 // batch_bytes)
    parts = []
    for i in range(batches):
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == i).orderBy("vec_id").toArrow().combine_chunks()
        ids = some.column("vec_id").to_numpy()
        batch = context.broadcast((ids, matrix(some.column("v").combine_chunks(), dims) if len(ids) else np.zeros((0, dims), np.int64)))
        seeds = blocks.mapInArrow(_thresholds(batch, k, group), "query long, score long, last long")
        best = seeds.groupBy("query").agg(F.max(F.struct("score", "last")).alias("best")).select("query", "best.score", "best.last").toArrow()
        score, last = np.full(len(ids), LEAST), np.full(len(ids), LAST)
        at = best.column("query").to_numpy()
        score[at], last[at] = best.column("score").to_numpy(), ~best.column("last").to_numpy()
        thresholds = context.broadcast((score, last))
        parts.append(staged(blocks.mapInArrow(_search(batch, thresholds, k, group), "query_id long, vec_id long, score long"), "found"))
        batch.unpersist()
        thresholds.unpersist()
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op12_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(100)) == 0)


ORACLE = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0))
WHERE rank <= 10
"""
