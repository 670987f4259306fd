"""Connected components and numbering of keyed rows, without a group or an order in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut


def roots(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``id, root``: least id of each component of ``edges(a, b)``, by propagation with pointer jumping.

    Rounds grow with the logarithm of a component's length; each ends in a written table.
    """
    both = edges.select("a", "b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    for _ in range(max_rounds):
        near = both.join(lab.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        step = lab.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "r").alias("mid"))
        jump = lab.select(F.col("id").alias("mid"), F.col("root").alias("far"))
        nxt = cut(step.join(jump, "mid", "left").select("id", "old", F.coalesce(F.least("mid", "far"), F.col("mid")).alias("root")))
        if not nxt.where("root <> old").limit(1).count():
            return lab
        lab = nxt.select("id", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``place``, their number in ``order`` from 1: a range sort, and one row for each of its partitions."""
    placed = cut(rows.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("i").alias("first"))  # a row for each partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(sizes, "part").withColumn("place", F.col("before") + F.col("i") - F.col("first") + 1).drop("part", "i", "first", "before")
