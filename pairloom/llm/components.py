"""Connected components of a table of links, by hooking and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _jumped(hooks: DataFrame) -> DataFrame:
    """Each node's root, from a table (node, to) whose arrows lead to smaller nodes. Every round halves the paths."""
    while True:
        up = hooks.select(F.col("node").alias("to"), F.col("to").alias("top"))
        after = C.materialize(hooks.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")))
        hooks = after.select("node", "to")
        if after.filter("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v) that is not its own root; the root is the smallest node reachable.

    Each round hooks every root to its smallest neighbour if that is smaller, follows the hooks to
    their ends, and rewrites the links by the roots found; links within a root go away.
    """
    roots, left = None, C.materialize(links.select("u", "v").filter("u <> v").distinct())
    while not left.isEmpty():
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = C.materialize(both.filter("v < u").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")))
        hooks = _jumped(hooks)
        if roots is None:
            roots = hooks
        else:
            moved = roots.join(hooks.select(F.col("node").alias("to"), F.col("to").alias("top")), "to", "left")
            roots = C.materialize(moved.select("node", F.coalesce("top", "to").alias("to")).unionByName(hooks))
        side = lambda df, c: df.join(hooks.select(F.col("node").alias(c), F.col("to").alias("top")), c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
        left = C.materialize(side(side(left, "u"), "v").filter("u <> v").distinct())
    if roots is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    return roots.select("node", F.col("to").alias("root"))
