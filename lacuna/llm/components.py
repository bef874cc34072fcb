"""Connected components of a graph given as pairs, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import with_row_of, written


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of pairs (a, b): the smallest node reachable.

    Each round every node takes the smallest label among its neighbours and itself, then that label's own label; the
    labels are written between rounds. Nodes with many links, and labels of many nodes, stay spread over tasks. Links
    that don't settle in most_rounds are an error.
    """
    both = written(pairs.select(F.col("a").alias("node"), "b").union(pairs.select(F.col("b").alias("node"), F.col("a").alias("b"))).where("node != b").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.min("b"), F.col("node")).alias("component"), F.count("*").alias("many")), "labels")
    links, weight = both.count(), None
    for _ in range(most_rounds):
        heard = with_row_of(both, labels, "node", "many", total=links).select(F.col("b").alias("node"), "component", F.lit(0).cast("long").alias("many"))
        least = heard.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"), F.max("many").alias("many"))
        least = written(least, "least-labels")
        sizes = least.groupBy("component").agg(F.count("*").alias("size"))
        after = labels.select(F.col("node").alias("component"), F.col("component").alias("next")).join(sizes, "component")
        labels = written(with_row_of(least, after, "component", "size").select("node", F.least("component", "next").alias("component"), "many"), "labels")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == weight:
            return labels.select("node", "component")
        weight = now
    raise RuntimeError("the links did not settle")
