"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged


def components(links: DataFrame) -> DataFrame:
    """node and root for every node of ``links`` (a, b); root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows these hooks to
    their ends, and contracts the links to the ends; rounds go on while links are
    left, and each at least halves the nodes of every component. Every step is
    written to the shared folder, so lineage stays short.
    """
    left = staged(links.select("a", "b").where("a <> b"), "links")
    roots: DataFrame | None = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        ends = _follow(staged(hooks, "hooks"))
        if roots is None:
            roots = ends
        else:
            step = ends.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = staged(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        ends_of = lambda side: ends.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        contracted = left.join(ends_of("a"), "a").join(ends_of("b"), "b").where("a_root <> b_root")
        left = staged(contracted.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
        if left.isEmpty():
            return roots


def _follow(hooks: DataFrame) -> DataFrame:
    """Every node with the end of its chain of hooks; each step makes the chains four times shorter."""
    while True:
        up = lambda name, to: hooks.select(F.col("node").alias(name), F.col("root").alias(to))
        once = hooks.join(up("root", "up"), "root").select("node", F.col("root").alias("was"), F.col("up").alias("root"))
        hooks = staged(once.join(up("root", "up"), "root").select("node", "was", F.col("up").alias("root")), "hooks")
        if hooks.where("was <> root").isEmpty():
            return hooks.select("node", "root")
