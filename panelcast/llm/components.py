"""Connected components of a link table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of `links`; label is the component's smallest node.

    Each round every node takes the smallest label among itself and its neighbours and
    then its label's label, so a chain of n nodes needs about log n rounds.  Rounds end
    when no label changes.  Every round's table is written to the shared folder.
    """
    both = stored(
        links.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .unionByName(links.select(F.col(b).alias("a"), F.col(a).alias("b")))
        .filter(F.col("a") != F.col("b"))
        .distinct(),
        "links",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Hook the old label's node too, so that whole trees move at once.
        hooks = spread.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        moved = stored(
            spread.join(hooks, "node", "left").select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label")),
            "labels",
        )
        jumped = stored(
            moved.join(moved.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
            .select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")),
            "labels",
        )
        labels = jumped.select("node", "label")
        if jumped.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
