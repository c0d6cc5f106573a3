"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the least node of its component, for every node of ``edges`` (columns a, b).

    ``edges`` should be a written table: every round reads it. Each round every node takes the least label of itself and
    its neighbours, then the label of its label, so long chains halve. Labels are written between rounds, so a lost
    executor costs one round at most, and joins go through plain shuffles, which adaptive execution splits where one node
    has very many edges.

    Defined results: repeated edges and edges in both directions count once; an edge from a node to itself makes it a
    component; edges with a null end are left out; an empty table gives an empty result; other columns are ignored.
    """
    known = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        lower = scratch.write(near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        if not lower.filter("label <> old").limit(1).count():
            return lower.select("node", "label")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = scratch.write(lower.join(jump, "label").select("node", F.least("label", "next").alias("label")), "labels")
