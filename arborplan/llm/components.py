"""Connected components by contraction, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the same for, and only for, nodes that reach each other.

    In each round every node hooks onto the smallest of itself and its neighbours, and links are contracted to the hooks.
    A component's local minima alone remain, half of its nodes at most, so the rounds grow with the logarithm of the largest
    component. Minima are combined before the shuffle, so a hub's links don't meet in one task. Nulls aren't nodes; a
    link of a node to itself makes it a component of its own.
    """
    with scratch(links.sparkSession):
        pairs = cut(links.select("a", "b").where("a is not null and b is not null"))
        roots = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("root", F.col("node")))
        pairs = pairs.where("a <> b")
        while not pairs.isEmpty():
            both = pairs.union(pairs.select("b", "a"))
            hook = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("to")))
            roots = cut(roots.join(hook, F.col("root") == F.col("n"), "left").select("node", F.coalesce("to", "root").alias("root")))
            left = pairs.join(hook, F.col("a") == F.col("n")).select(F.col("to").alias("ta"), "b")
            pairs = cut(left.join(hook, F.col("b") == F.col("n")).select(F.col("ta").alias("a"), F.col("to").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        return cut(roots, keep=True)
