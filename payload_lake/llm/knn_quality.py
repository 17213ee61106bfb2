"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes two groups of hashed terms: byte 1- to 3-grams (case kept) and 1-
and 2-grams of word shapes. The shape of a word are the classes of its characters
(lower case, upper case, digit; each sign for itself; other letters as lower case),
runs of a class once. Counts of whole texts are weighted by logarithmic frequency
and by inverse document frequency over all documents, each group is scaled to its
length, and all are projected on the leading singular vectors of the labelled
sample. The labelled vectors are broadcast, and every document gets the exact
cosine with all of them, in blocks; the ``neighbours`` nearest vote with weight
cosine ** ``power``.

The labelled sample holds at most ``MAX_LABELLED`` documents (the first in the
order of a hash of their id), so what is collected and broadcast is bounded by
``MAX_LABELLED`` times ``TERMS`` counts and ``MAX_LABELLED`` times ``DIMS``
coordinates. Document frequencies are summed in each task before they are
collected. Scoring is a map without a shuffle.

Votes are corrected for the uneven number of labels: each vote of a label
counts in inverse proportion to how often the sample has it, to the power of
``BALANCE``.

Defined cases: an empty or null text has no direction and gets the share of
label 1 in the sample; equal texts get equal scores (cosines are rounded, as their
last bits depend on the block); neighbours tied with the last one all vote;
without labelled rows every score is 0.5; a row with a null doc_id
is scored and not learned from, and the query holds it out, like any whose doc_id has no
remainder; doc_id may be of any type and stays as it is; texts are read whole; repeated
rows are scored one by one; an empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngram_features import bounded_sample, counts, dense, remainder, row_blocks, sparse_rows
from .stage import staged, table
from .words import Chunk, binary_column, chunks, gram_hashes, prefix_sums, span_hashes, words

MAX_LABELLED = 4000
#: buckets of byte n-grams and of shapes (powers of two), and the weight of each group
BUCKETS, SHAPES = 2048, 256
TERMS = BUCKETS + SHAPES
GROUP_WEIGHT = (0.5, 1.0)
SIZES = (1, 2, 3)
DIMS = 128
NEIGHBOURS = 25
POWER = 16
BALANCE = 0.5
THRESHOLD = 0.3
#: letters stand for their case, white space and digits for themselves; signs stay apart
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[[9, 11, 12, 13]] = 32
SHAPE[48:58] = 48
CLASS = np.arange(256, dtype=np.uint8)
CLASS[97:123] = CLASS[128:] = 97
CLASS[65:91] = 65
CLASS[48:58] = 48


class Model(NamedTuple):
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def shape_counts(chunk: Chunk) -> np.ndarray:
    """Counts of the shapes of words and of pairs of neighbours, per row and bucket."""
    w = words(chunk)
    classes = CLASS[chunk.data]
    kept = np.ones(len(classes), bool)
    kept[1:] = classes[1:] != classes[:-1]
    kept[w.starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    sums, down = prefix_sums(classes[kept])
    shapes = span_hashes(sums, down, place[w.starts], place[w.ends])
    low = np.uint64(SHAPES - 1)
    one, two = (shapes & low).astype(np.int64), (gram_hashes(shapes, 2) & low).astype(np.int64)
    out = np.zeros((len(w.rows) - 1, SHAPES), np.float32)
    for i, (a, b) in enumerate(pairwise(w.rows)):
        out[i] = np.bincount(one[a:b], minlength=SHAPES)
        if b - a > 1:
            out[i] += np.bincount(two[a : b - 1], minlength=SHAPES)
    return out


def terms(chunk: Chunk) -> np.ndarray:
    """Counts of byte n-grams, then those of shapes."""
    return np.hstack([counts(chunk, SIZES, BUCKETS, SHAPE), shape_counts(chunk)])


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x.astype(np.float64)) * idf
    groups = [x[:, :BUCKETS], x[:, BUCKETS:]]
    return np.hstack([w * g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12) for w, g in zip(GROUP_WEIGHT, groups, strict=True)])


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(size > 1e-9, v / np.maximum(size, 1e-9), 0.0)


def singular_vectors(x: np.ndarray, dims: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration."""
    rng = np.random.default_rng(7)
    dims = max(1, min(dims, *x.shape))
    q = rng.standard_normal((x.shape[1], min(x.shape[1], dims + 16)))
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dims]


def fit(counted: np.ndarray, labels: np.ndarray, idf: np.ndarray) -> Model | None:
    if not len(labels):
        return None
    x = _weighted(counted, idf)
    basis = singular_vectors(x, DIMS)
    return Model(idf, basis, _unit(x @ basis), labels.astype(np.float64), float(labels.mean()))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the terms over all rows of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for chunk in chunks(binary_column(batch, "text")):
                for block in row_blocks(chunk, 256):
                    seen += (terms(block) > 0).sum(axis=0)
                    rows += block.stop - block.start
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(seen, rows))], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().sort_by("term")
    n = found["n"].to_numpy() if found.num_rows else np.zeros(TERMS + 1)
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 1


def vote(model: Model, vectors: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors of each row."""
    close = np.round(vectors @ model.vectors.T, 7)
    k = min(neighbours, close.shape[1])
    last = np.partition(close, -k, axis=1)[:, -k]
    weight = np.where(close >= last[:, None], np.maximum(close, 0), 0) ** power
    share = np.array([1 - model.prior, model.prior])
    weight *= (1 / np.maximum(share, 1e-9) ** BALANCE)[model.labels.astype(np.int64)]
    total = weight.sum(axis=1)
    share = (weight * model.labels).sum(axis=1) / np.maximum(total, 1e-12)
    return np.clip(np.where(total > 1e-12, share, model.prior), 0, 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """A model of labelled rows; ``labels`` has doc_id and the 0/1 column ``label``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id"), F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = staged(bounded_sample(known, MAX_LABELLED, F.struct(F.xxhash64("doc_id"), "doc_id")), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    found = sparse_rows(rows, terms).toArrow().sort_by("doc_id")
    return fit(dense(found, TERMS), found["label"].to_numpy(), document_frequencies(docs)) if found.num_rows else None


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for chunk in chunks(binary_column(batch, "text")):
                for block in row_blocks(chunk, 256):
                    if shared.value is None:
                        scores.append(np.full(block.stop - block.start, 0.5))
                        continue
                    x = _weighted(terms(block), shared.value.idf)
                    scores.append(vote(shared.value, _unit(x @ shared.value.basis)))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(remainder("doc_id", 5) != 0))
    return classify(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
