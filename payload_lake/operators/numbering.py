"""Numbers inside groups of any size, by two passes of prefix sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered(rows: DataFrame, by: list[str], order_by: list[str | Column], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, their place from 1 in their group by ``order_by``.

    ``row_number`` over a group sorts it in one task. Here sampled ranges of group and
    order are written first, so an account with most of the rows lies in most of the
    ranges; each range is counted, the counts before it are summed (a row for each
    group and range), and rows are numbered inside their range. A null group is a
    group of its own. Rows that ``order_by`` does not tell apart share a range.
    """
    kept = written(rows.repartitionByRange(*by, *order_by).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = kept.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = counts.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = kept.withColumn("__place", F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order_by)))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)]
    joined = inside.join(sums, reduce(lambda a, b: a & b, same, F.col("__range") == F.col("__r")))
    return joined.select(*rows.columns, (F.col("__before") + F.col("__place")).alias(name))
