"""Connected components of a table of links, by alternating large and small stars.

A large star links every larger neighbour of a node to the node's smallest neighbour; a small star does the same with
the node and its smaller neighbours. Rounds alternate until nothing changes; their number grows with the logarithm of
the longest chain. Each round is aggregations and joins whose tables go to the shared folder; nothing is collected. The
links of a node that has many (the centre of a large star) are dealt to several tasks.

Defined results: links with a null end are ignored; a link of a node with itself is none; repeated and reversed links
count once; no links give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Large: with u's neighbours on either side; small: with v, the smaller end, and u itself."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
    found = common.materialize(found, "links-least")
    least = found.select("u", "m")
    met = common.hot_join(near, least, "u", found.select("u", "n"), "v")
    if large:
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")  # repeats go in the small star
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) of longs. (node, component) of every node that has a link; a component is named by its least."""
    edges = common.materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        after = common.materialize(_star(common.materialize(_star(edges, True), "links-large"), False), "links")
        # both are sets, so they are the same if they have as many links and none is new
        same = edges.count() == after.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    least = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least.select("node", F.col("node").alias("component")))
