"""Connected components of an edge list, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.session import cut_lineage


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` for every row of ``nodes`` (column id): the smallest id reachable over ``edges`` (a, b).

    Every round hands each node the smallest among the labels of its neighbours and the label of its label, so labels
    travel twice as far each time. A round writes only the nodes that have an edge; the loop ends when no label changes. Ids
    must not be null. Without edges every node is its own component.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        step = labels.join(near, "id").join(jump, "label")
        step = step.select("id", F.col("label").alias("old"), F.least("near", "next").alias("label"))
        step = cut_lineage(step, "labels")
        labels = step.select("id", "label")
        if step.where("label <> old").isEmpty():
            break
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
