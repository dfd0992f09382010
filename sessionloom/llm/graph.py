"""Connected components of an edge table, by contracting it round after round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for every node of ``edges`` (columns ``a``, ``b``).

    Each round every node hooks onto its smallest neighbour, chains of hooks are cut short by pointer jumping, and the
    edges are rewritten to what remains. Every table of a round is written, so joins start from plain
    scans whose hot keys AQE can split. Only row counts reach the driver.
    """
    edges = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    rest = materialise(edges.distinct(), "graph-edges")
    labels = None
    while rest.limit(1).count():
        hooks = rest.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        hooks = materialise(hooks, "graph-hooks")
        while True:
            upper = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialise(hooks.join(upper, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "graph-hooks")
            hooks = jumped.drop("moved")
            if not jumped.where("moved").limit(1).count():
                break
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("label"))
        else:
            step = hooks.select(F.col("node").alias("label"), "up")
            labels = materialise(labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "graph-labels")
        left, right = (hooks.select(F.col("node").alias(c), F.col("up").alias(c + "2")) for c in ("a", "b"))
        rest = materialise(
            rest.join(left, "a").join(right, "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "graph-edges"
        )
    return labels if labels is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("label"))
