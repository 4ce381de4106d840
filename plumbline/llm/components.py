"""Connected components of sparse similarity links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import stored

MAX_ROUNDS = 60


def smallest_reachable(links: DataFrame) -> DataFrame:
    """Per linked node: node, label (smallest node it reaches).

    ``links`` has columns u and v. Every round offers each node
    and its present root the smallest label next to it, then follows labels one
    step, so paths halve. Minima are combined before the shuffle; the label
    lookup joins stored tables, whose hot labels the runtime can split. Each
    round is stored; a round without a change ends the search.
    """
    links = stored(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(links.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
    for _ in range(MAX_ROUNDS):
        seen = links.join(labels, links["v"] == labels["node"]).select("u", "label")
        nearest = seen.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        offers = stored(labels.join(nearest, "node").select("node", "label", F.least("label", "near").alias("near")))
        better = offers.select("node", "near").unionByName(offers.select(F.col("label").alias("node"), "near")).groupBy("node").agg(F.min("near").alias("near"))
        hooked = stored(offers.select("node", "label").join(better, "node").select("node", F.col("label").alias("before"), F.col("near").alias("label")))
        root = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stored(hooked.join(root, "label").select("node", "before", F.col("root").alias("label")))
        changed = jumped.filter(F.col("before") != F.col("label")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
