"""Connected parts of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.common import saved


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the least node it is connected with.

    Each round a node takes the least label among its neighbours and itself,
    then the label of that label, so long chains halve. Minima combine before
    the shuffle, which keeps a node with very many links cheap. Rounds are
    written to the shared folder and end when nothing changes.
    """
    both = saved(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = saved(
            lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels"
        )
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels
