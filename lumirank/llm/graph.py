"""Connected components of a link table, by contraction rounds on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumirank.session import stable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long); root is the smallest node it reaches.

    Each round points every node to its smallest neighbour, follows the pointers twice, and
    contracts the edges to the roots; edges within a root vanish, and every node with an edge
    left that isn't its own neighbourhood's minimum merges. Rounds are written to the shared
    folder, which cuts the lineage. Nodes reach the driver never, only whether edges are left.
    A node with very many links is aggregated map-side; joins on it are split by AQE.
    """
    e = stable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = stable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
                   .select("node", F.least("node", "up").alias("up")))
        for _ in range(2):
            q = p.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            p = p.join(q, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        p = stable(p)
        if labels is None:
            labels = p.select("node", F.col("up").alias("root"))
        else:
            labels = stable(labels.join(p.select(F.col("node").alias("root"), "up"), "root", "left")
                            .select("node", F.coalesce("up", "root").alias("root")))
        e = stable(e.join(p.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
                   .join(p.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
                   .filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
