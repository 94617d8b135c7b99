"""Connected components of a graph given as a table of edges, by contraction to local minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import forget, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node) for every node of an edge; edges are unordered, null ends are dropped.

    Each round sends every node along its least neighbours to a local minimum, by pointer jumping, and
    replaces edges by those between different minima; at most half the nodes stay. All tables are
    stored, never collected, and dropped at their last use, but for the result. Edges that repeat count once; no edges
    give no rows; other columns are not used.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = stored(both.union(both.select("b", "a")).distinct(), "edges")
    labels = None
    while True:
        up = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        up = stored(up.withColumn("moved", F.lit(True)), "up")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = stored(up.select("node", "up").join(above, "up").select("node", F.col("next").alias("up"), (F.col("next") < F.col("up")).alias("moved")), "up")
            forget(up)
            up = jumped
            if not up.where("moved").take(1):
                break
        if labels is None:
            named = stored(up.select("node", F.col("up").alias("component")), "labels")
        else:
            step = up.select(F.col("node").alias("component"), F.col("up").alias("next"))
            named = stored(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
            forget(labels)
        labels = named
        left = both.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        left = left.join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        rest = stored(left.where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), "edges")
        forget(both, up)
        both = rest
        if not both.take(1):
            forget(both)
            return labels
