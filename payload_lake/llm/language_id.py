"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are trained by follow-the-regularised-leader with per-coordinate
rates and elastic-net penalties, so weights that do not pay stay exactly 0; the
scores are then calibrated by one temperature on rows kept out of the training.

The model learns from a bounded sample: at most ``PER_LANGUAGE`` rows of each
language and ``MAX_ROWS`` rows in all, chosen by a hash of their id,
shared out over the languages. What is collected is their hashed counts, at most ``MAX_ROWS`` times ``BUCKETS``.
Predicting is a map without a shuffle over whole texts.

Defined cases: a null text or one without a letter (``str.isalpha``) gets ``und``
and score 0; rows whose lang is null are not learned from; with nothing to learn
from, every prediction is ``und``; equal texts get equal predictions; the
query holds rows out whose doc_id is null; doc_id may be of any type and stays as it is;
texts are read whole; an empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngram_features import bounded_sample, char_counts, dense, remainder, row_blocks, sparse_rows
from .stage import small_side, staged, table
from .words import binary_column, chunks

PER_LANGUAGE = 1000
MAX_ROWS = 8000
BUCKETS = 4096
SIZES = (1, 2, 3)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, batch: int = 16) -> np.ndarray:
    """Weights (columns of x by classes) after ``epochs`` passes in a fixed random order."""
    z, n = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))

    def weights() -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            rows = order[start : start + batch]
            part, w = x[rows], weights()
            p = softmax(part @ w)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = part.T @ p
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
            n += g * g
    return weights()


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search."""
    if not len(y):
        return 1.0
    loss = lambda log_t: -np.log(softmax(scores / np.exp(log_t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(counted: np.ndarray, names: list[str]) -> Model | None:
    if not names:
        return None
    languages = sorted(set(names))
    y = np.array([languages.index(x) for x in names])
    idf = (np.log((1 + len(y)) / (1 + (counted > 0).sum(axis=0))) + 1).astype(np.float32)
    x = np.hstack([_weighted(counted, idf), np.ones((len(y), 1), np.float32)])
    kept_out = np.arange(len(y)) % 5 == 4
    train = ~kept_out if kept_out.any() else np.ones(len(y), bool)
    w = ftrl(x[train], y[train], len(languages))
    temperature = calibrate(x[kept_out] @ w, y[kept_out])
    return Model(languages, idf, w[:-1].astype(np.float32), w[-1].astype(np.float32), temperature)


def train(docs: DataFrame) -> Model | None:
    """A model of rows with text, doc_id and a non-null lang."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = small_side(staged(sizes.select("lang", F.least(F.lit(1.0), F.lit(1.2 * PER_LANGUAGE) / F.col("n")).alias("share")), "languages"))
    spread = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)).alias("place")
    chosen = known.select("doc_id", "lang", spread).join(share, "lang").where("place < share").select("doc_id", "lang", "place")
    # by rank in the language, so that the rows are shared out over languages and those of few rows come whole
    ranked = chosen.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id")))
    bounded = staged(bounded_sample(ranked, MAX_ROWS, F.struct("rank", "place", "doc_id", "lang")).select("doc_id", F.col("lang").alias("name")), "language-sample")
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(bounded.distinct()), "doc_id").where("lang = name").select("doc_id", "lang", "text")
    found = sparse_rows(rows, lambda chunk: char_counts(chunk, SIZES, BUCKETS)).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")]).slice(0, MAX_ROWS)
    return fit(dense(found, BUCKETS), found["lang"].to_pylist())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, scores, best = shared.value, [], []
            values = binary_column(batch, "text")
            known = np.array([has_letter(x.as_py().decode("utf-8", "replace")) for x in values], bool)
            for chunk in chunks(values):
                for block in row_blocks(chunk, 256):
                    if model is None:
                        scores.append(np.zeros(block.stop - block.start))
                        best.append(np.zeros(block.stop - block.start, np.int64))
                        continue
                    x = _weighted(char_counts(block, SIZES, BUCKETS), model.idf)
                    # as much rounded as the order of sums may differ between blocks, so that equal texts get equal scores
                    p = np.round(softmax((x @ model.weights + model.bias) / model.temperature).astype(np.float64), 4)
                    best.append(p.argmax(axis=1))
                    scores.append(p.max(axis=1))
            best, scores = (np.concatenate(v) if v else np.zeros(0) for v in (best, scores))
            ok = known & (model is not None)
            names = [model.languages[int(k)] if o else "und" for k, o in zip(best, ok, strict=True)]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(np.where(ok, scores, 0.0).astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder("doc_id", 3) != 1))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(True))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
