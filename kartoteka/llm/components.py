"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its smallest node.

    Each round a component goes to its least neighbour, that one's least neighbour and so on to the end of the chain, so those
    with open edges halve; labels and edges are written each round, edges within one component are dropped, and it ends when
    none is left. Labels are least values per key, summed up before the shuffle, and joins may be split where a node is hot.
    """
    labels = C.written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    while True:
        # the edges in terms of components: a component's label goes down to the least that it touches
        ends = (
            edges.join(labels.select(F.col("node").alias("a"), F.col("component").alias("u")), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("component").alias("v")), "b")
            .where("u != v")
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .distinct()
        )
        open_edges = C.written(ends, "edges")
        if open_edges.isEmpty():
            return labels
        labels = C.written(_jumped(labels, open_edges), "labels")
        edges = open_edges.toDF("a", "b")
        # nodes that are components are in labels too, as a component is its smallest node


def _jumped(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each component goes to the least component at the end of its descending chain of least neighbours, whose own label stays."""
    # written, so that a join on `to`, where a star's members meet, can be split
    down = C.written(edges.groupBy(F.col("v").alias("component")).agg(F.min("u").alias("to")), "down")
    while True:  # twice as many steps each time
        again = down.select(F.col("component").alias("to"), F.col("to").alias("further"))
        steps = C.written(down.join(again, "to", "left").select("component", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "steps")
        down = steps.select("component", "to")
        if steps.where("moved").isEmpty():
            return labels.join(down, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
