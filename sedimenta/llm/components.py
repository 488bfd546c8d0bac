"""Connected components of a link table by rounds of neighbour minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links`` (a, b): label is the smallest node it is joined to.

    Each round takes the smallest label among neighbours and then that
    label's own label, so chains shorten geometrically; a round is a table in
    the shared folder, and no node list or link list reaches the driver.
    """
    both = staged(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    at = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(at.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = at.join(near, at["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = at.select(F.col("node").alias("next"), F.col("label").alias("further"))
        moved = staged(
            lower.join(jump, "next").select("node", F.col("label").alias("was"), F.least("next", "further").alias("label")),
            "labels",
        )
        at = moved.select("node", "label")
        if moved.where("was != label").limit(1).count() == 0:
            return at
