"""Corpus preparation: quality rules, line dedup, near-dedup, decontamination, encoding.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` writes the result of each as Parquet in the shared
folder and reads it back as the documents of the next; what a stage staged on its
way is removed then.

Defined cases, of each stage by its operator: null and empty texts fail the quality
rules; rows with a null doc_id pass the later stages untouched, as they are no copy
and hold no line of another; repeated rows are kept or dropped alike; very long
texts are read whole; further columns, whatever their names, are passed on; an
empty table stays empty.

The caller runs what a stage returns, so a stage lowers Spark's bytes of an Arrow batch
(64 MB by default) to ``BATCH`` for the session; a lower setting stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from payload_lake.llm.decontaminate import without_leaks
from payload_lake.llm.line_dedup import dedup_texts
from payload_lake.llm.near_dedup import keep_one
from payload_lake.llm.perplexity import keep_good
from payload_lake.llm.sentencepieces import encode
from payload_lake.llm.stage import settled, small_batches, table

#: bytes that go to Python at once: the JVM and Python hold the texts of a batch, some of them twice
BATCH = 4 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stand outside the perplexity band of their language go."""
    small_batches(spark, BATCH)
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    small_batches(spark, BATCH)
    return dedup_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays."""
    small_batches(spark, BATCH)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go."""
    small_batches(spark, BATCH)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its SentencePiece ids."""
    small_batches(spark, BATCH)
    return encode(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near),
    ("decontamination", decontaminate),
    ("sentencepiece", pieces),
]

#: a trained language model and the encoder stand outside SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(functools.partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
