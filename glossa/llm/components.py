"""Connected components of a graph that is only ever a distributed table.

Edges are (child, parent) with parent < child. A round first gives each child its smallest parent and hangs its other
parents under that one (a join on the child), then lets every child skip to its parent's parent. Edges
stay connected in both steps and every step lowers parents, so the rounds end with each node under the smallest node of
its component; the number of rounds grows with the logarithm of the longest chain. Every round is written to the shared
folder, so lineage stays short, and the tables of the round before are deleted; only two counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import checkpointed, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a smaller one in its component, from edges (a, b) of long columns in any order."""
    pair = edges.filter("a is not null and b is not null and a <> b")
    held = base = checkpointed(pair.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")))
    while True:
        least = held.groupBy("child").agg(F.min("parent").alias("m"))
        # A node may have any number of parents: they are joined with the smallest, never listed in a row.
        met = held.join(least, "child").filter("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        joined = met.unionByName(least.select("child", F.col("m").alias("parent"))).distinct()
        up = joined.groupBy("child").agg(F.min("parent").alias("above")).withColumnRenamed("child", "parent")
        step = checkpointed(joined.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        state = step.agg(F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)).alias("moved"), F.count(F.lit(1)).alias("rows")).first()
        done = not state["moved"] and state["rows"] == step.select("child").distinct().count()
        forget(base)
        if done:
            return step.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        held, base = step.select("child", "parent"), step
