"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakegauge.llm.common import stored


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after the links (a, b) between nodes have joined components: each gets its smallest label.

    Every round each component takes the smallest label next to it, follows that label twice, and what is left of the
    links is drawn between the new components. A hub's links are reduced by a minimum before they meet in one task.
    """
    if links.isEmpty():
        return labels
    seen = labels.select(F.col("node").alias("n0"), F.col("comp").alias("c0"))
    edges = (links.join(seen, links.a == F.col("n0")).select("b", F.col("c0").alias("u"))
             .join(seen, F.col("b") == F.col("n0")).select("u", F.col("c0").alias("v")))
    edges = stored(edges.where("u <> v").distinct(), "links")
    rounds = 0
    while not edges.isEmpty():
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        # stored, as following the labels reads it four times
        up = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("root")), "least")
        for _ in range(2):
            step = up.select(F.col("u").alias("via"), F.col("root").alias("further"))
            up = up.join(step, up.root == step.via, "left").select("u", F.coalesce("further", "root").alias("root"))
        up = stored(up, "labels")
        labels = labels.join(up, labels.comp == up.u, "left").select("node", F.coalesce("root", "comp").alias("comp"))
        a, b = up.select(F.col("u").alias("ua"), F.col("root").alias("a")), up.select(F.col("u").alias("ub"), F.col("root").alias("b"))
        edges = stored(edges.join(a, edges.u == a.ua).join(b, edges.v == b.ub).select(F.col("a").alias("u"), F.col("b").alias("v"))
                       .where("u <> v").distinct(), "links")
        rounds += 1
        if rounds % 4 == 0:
            labels = stored(labels, "labels")
    return stored(labels, "labels")
