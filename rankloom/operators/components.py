"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b); component is the smallest id that can be reached.

    Every round a node takes the smallest label among itself and its
    neighbours and then the label of that label, so that a chain shortens by
    more than half.  Labels are saved tables, and the joins on a hub's id are
    plain joins of two scans, which Spark splits where they are skewed; the
    minimum per node is pre-aggregated before its shuffle.  Ends when no label
    changed.  Loops and repeated edges do no harm; no edges give no rows.
    """
    both = ws.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = ws.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = ws.save(labels.join(near, "id").select("id", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        jump = hooked.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        after = ws.save(hooked.join(jump, "label").select("id", F.least("label", "beyond").alias("label"), (F.col("moved") | (F.col("beyond") < F.col("label"))).alias("moved")))
        ws.drop(labels, hooked)
        labels = after
        if labels.filter("moved").isEmpty():
            ws.drop(both)
            return labels.select("id", F.col("label").alias("component"))
