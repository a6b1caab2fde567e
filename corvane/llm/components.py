"""Connected components by hooking to the smallest neighbour and pointer jumping, with staged rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def connected_components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, comp): comp is the smallest node of the component. The result is staged; so are the labels, which stay.

    links: (a, b). labels: components found before, which the links may join. Nodes without links or labels are not listed.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    if labels is None:
        comps = nodes.withColumn("comp", F.col("node"))
    else:
        comps = labels.unionByName(nodes.join(labels, "node", "left_anti").withColumn("comp", F.col("node")))
    comps = stage(comps, "comps")
    edges = links
    while True:
        left, right = comps.select(F.col("node").alias("a"), F.col("comp").alias("u")), comps.select(F.col("node").alias("b"), F.col("comp").alias("v"))
        held = edges if edges is not links else None
        edges = edges.join(left, "a").join(right, "b").where("u <> v")
        edges = stage(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "edges")
        discard(held)
        if edges.isEmpty():
            discard(edges)
            return comps
        # each component hooks to its smallest neighbour, if smaller; edges already name components
        parent = stage(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("up")), "parents")
        first = parent
        for _ in range(2):
            above = parent.select(F.col("x").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up", "left").select("x", F.coalesce("top", "up").alias("up"))
        moved = comps.join(parent.withColumnRenamed("x", "comp"), "comp", "left")
        fresh = moved.select("node", F.coalesce("up", "comp").alias("comp"))
        # the components themselves are nodes of what is left
        fresh = stage(fresh, "comps")
        discard(first, comps)
        comps = fresh
