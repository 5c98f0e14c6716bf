"""Connected components of a table of links, by contraction: every node hooks to its least neighbour, paths are halved, links between what remains go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import written


def components(links: DataFrame, where: str) -> DataFrame:
    """node, component (the least node of its component) for every node in links (a, b: long); nothing is collected to the driver."""
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), where, "edges0")
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both(edges).select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), where, "labels0")
    k = 0
    while not edges.isEmpty():
        k += 1
        hook = both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        up = hook.select(F.col("a").alias("to"), F.col("to").alias("top"))
        parents = written(hook.join(up, "to").select("a", F.col("top").alias("to")), where, f"parents{k}")
        of = lambda n: parents.select(F.col("a").alias(n), F.col("to").alias(f"{n}_to"))
        labels = written(labels.join(of("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")), where, f"labels{k}")
        moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = written(moved.filter("a <> b").distinct(), where, f"edges{k}")
    return labels
