"""Connected components of a table of links, without ever collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds that thin out links before labels go round.
CONTRACTIONS = 2


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for each node of ``links(a, b)``.

    Each round takes the smallest label among a node and its neighbours and then jumps to that label's own label, so
    chains shrink by more than half a round. Labels are written to shared storage each round, so a lost executor costs one
    round's tasks. Null ends are ignored; no links give no rows.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for _ in range(CONTRACTIONS):
        # all smaller neighbours of a node, and the node, hang on the smallest of them: still connected, and a dense group keeps about a link a node
        least = edges.groupBy("b").agg(F.min("a").alias("least"))
        hung = edges.join(least, "b")
        edges = hung.select(F.col("least").alias("a"), "b").union(hung.filter("a <> least").select("least", F.col("a").alias("b"))).distinct()
        edges = common.materialise(edges, "links")
    both = common.materialise(edges.union(edges.select("b", "a")), "links")
    labels = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("least"))
        step = labels.join(seen, labels.node == seen.a, "left").select("node", F.col("root").alias("old"), F.least("root", "least").alias("now"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        step = step.join(up, F.col("now") == F.col("up"), "left").select("node", "old", F.least("now", "up_root").alias("root"))
        step = common.materialise(step, "labels")
        labels = step.select("node", "root")
        if step.filter("old <> root").isEmpty():
            return labels
