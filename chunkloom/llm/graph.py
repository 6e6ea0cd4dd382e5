"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of ``links`` (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so chains
    shrink by half. Minima are combined before they are shuffled. Rounds go on until nothing changes.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = written(
        pairs.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")),
            F.struct(F.col("a").alias("node"), F.col("a").alias("near")), F.struct(F.col("b").alias("node"), F.col("b").alias("near")),
        )).alias("e")).select("e.node", "e.near").distinct(), "graph-edges",
    )
    labels = edges.groupBy("node").agg(F.min("near").alias("component"))
    labels = written(labels.withColumn("moved", F.lit(True)), "graph-labels")
    while not labels.where("moved").isEmpty():
        near = labels.select(F.col("node").alias("near"), "component")
        smallest = edges.join(near, "near").groupBy("node").agg(
            F.min("component").alias("least"), F.max(F.when(F.col("near") == F.col("node"), F.col("component"))).alias("before")
        )
        jump = labels.select(F.col("node").alias("least"), "component")
        before, labels = labels, written(
            smallest.join(jump, "least").select("node", "component", (F.col("component") < F.col("before")).alias("moved")), "graph-labels"
        )
        dropped(before)
    dropped(edges)
    return labels.select("node", "component")


def star_components(links: DataFrame) -> DataFrame:
    """``components`` for links (a < b) in which each ``b`` has few partners, as members of buckets have leaders.

    Every member is tied to its smallest partner only, and its other partners to that one; what is left is a graph of
    the leaders, which is far smaller than the links. Members then take the label of their smallest partner.
    """
    tied = written(links.where("a <> b").groupBy("b").agg(F.collect_set("a").alias("all")).select("b", "all", F.array_min("all").alias("least")), "graph-ties")
    leaders = written(tied.select(F.explode("all").alias("a")).distinct(), "graph-leaders")
    among = tied.select(F.col("least").alias("a"), F.explode("all").alias("b")).where("a <> b").unionByName(
        tied.join(leaders.select(F.col("a").alias("b")), "b", "left_semi").select(F.col("least").alias("a"), "b")
    )
    labels = components(written(among.distinct(), "graph-leader-links"))
    members = tied.select(F.col("b").alias("node"), "least").unionByName(
        leaders.join(tied.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("least"))
    )
    out = written(
        members.join(labels.withColumnRenamed("node", "least"), "least", "left").select("node", F.coalesce("component", "least").alias("component")),
        "graph-labels",
    )
    dropped(tied, leaders)
    return out


def joined_components(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links ``more`` (a, b) between components, which are named by their labels."""
    above = components(more).select(F.col("node").alias("component"), F.col("component").alias("better"))
    known = labels.join(above, "component", "left").select("node", F.coalesce("better", "component").alias("component"))
    alone = above.select(F.col("component").alias("node"), F.col("better").alias("component")).join(labels.select("node"), "node", "left_anti")
    return written(known.unionByName(alone), "graph-labels")
