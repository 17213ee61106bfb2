"""Reading tables, cutting lineage, size-checked broadcasts and the memory of Python workers for the llm operators."""

from __future__ import annotations

import ctypes
import functools
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch



class _Open(threading.local):
    """For each ``settled`` call that is open in this thread, the paths staged in it."""

    def __init__(self) -> None:
        self.calls: list[list[str]] = []


_open = _Open()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, survives lost executors, and leaves
    a plain scan, so a join over it keeps skew-join splitting.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if _open.calls:
        _open.calls[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``staged(build(), name)``; what ``build`` staged on the way is removed once the result is written."""
    _open.calls.append([])
    try:
        df = build()
        out = staged(df, name)
    finally:
        inner = _open.calls.pop()
    remove(df.sparkSession, inner[:-1])
    if _open.calls:
        _open.calls[-1].append(inner[-1])
    return out


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def small_side(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def trim() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if of_glibc := getattr(ctypes.CDLL(None), "malloc_trim", None):
        of_glibc(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` (of mapInArrow), after which the worker gives its free memory back: it waits for the next task beside a JVM that needs it."""

    @functools.wraps(run)
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return runs


def small_batches(spark: SparkSession, size: int) -> None:
    """From now on rows of about ``size`` bytes, one at least, go to Python at once in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > size:
        spark.conf.set(key, size)


def numbered_ids(df: DataFrame, name: str = "doc_id") -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with long ids in the order of its ids, and what puts the given ids back into named columns.

    Integers are their own numbers. Ids of any other type that orders (texts, decimals, ...)
    are numbered in sampled ranges, written once, and joined by the id; null stays null.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return df.withColumn(name, F.col(name).cast("long")), lambda out, *columns: out.withColumns({c: F.col(c).cast(kind) for c in columns})
    given = df.select(F.col(name).alias("__id")).where("__id is not null").distinct()
    known = staged(given.repartitionByRange("__id").sortWithinPartitions("__id").withColumn("__number", F.monotonically_increasing_id()), "ids")
    numbered = df.hint("merge").join(known, F.col(name) == F.col("__id"), "left").withColumn(name, F.col("__number")).select(*df.columns)

    def back(out: DataFrame, *columns: str) -> DataFrame:
        names = out.columns
        for c in columns:
            out = out.hint("merge").join(known, F.col(c) == F.col("__number"), "left").withColumn(c, F.col("__id")).select(*names)
        return out

    return numbered, back
