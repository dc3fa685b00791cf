"""Connected components of a stored list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of a link with the smallest node that links lead to.

    Each round takes the least label among the neighbours and then the label's own label, so
    long chains shrink fast. A round is one written table; neighbours are reduced to their
    minimum before they are shuffled, so a node with very many links is no hot group.
    """
    both = materialise(
        links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct(), "links")
    labels = materialise(
        both.groupBy("node").agg(F.min("other").alias("least")).select(
            "node", F.least("node", "least").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(
            F.min("label").alias("near"))
        lower = labels.select("node", F.col("label").alias("old")).join(near, "node").select(
            "node", "old", F.least("old", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        labels = materialise(
            lower.join(jump, "low").select(
                "node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("old")).alias("moved")),
            "labels")
    return labels.select("node", "label")
