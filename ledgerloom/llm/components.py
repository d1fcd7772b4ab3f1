"""Connected components of a link table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every id of ``links(a, b)``.

    Each round takes the smallest label among the neighbours and then the label of that label, so that long chains
    shrink by half; every round is a written table, and no round gathers a group.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links"
    )
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).select(F.col("a").alias("id"), "component"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", "component", F.least("component", F.coalesce("near", "component")).alias("next")
        )
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("beyond"))
        moved = nearer.join(jump, nearer["next"] == jump["to"], "left").select(
            "id", F.least("next", F.coalesce("beyond", "next")).alias("component"), (F.col("component") != F.least("next", F.coalesce("beyond", "next"))).alias("moved")
        )
        kept = stored(moved, "labels")
        labels = kept.select("id", "component")
        if not kept.filter("moved").take(1):
            return labels
