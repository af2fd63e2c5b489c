"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of the edges (a, b: two columns of one orderable type).

    Every round takes the least label among a node's neighbours (an aggregation combined
    before its shuffle, so that a node with very many edges is no hot group), then lets
    each label jump to the label of the node it names. Rounds grow with the logarithm of
    the longest path; each is written to the shared folder, and no list of nodes leaves
    the executors. Null ends are ignored; an empty table gives an empty result.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = store.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    table = labels
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        # the label's own label: labels are nodes, so a lookup by it finds one row
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = store.written(hooked.join(jump, "component").select("node", F.least("component", "next").alias("component"), "old"), "labels")
        same = moved.filter("component <> old").limit(1).count() == 0
        store.removed(table)
        table, labels = moved, moved.select("node", "component")
        if same:
            store.removed(both)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
