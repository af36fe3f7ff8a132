"""Connected components of a graph that no single machine need hold.

Alternating large-star and small-star rounds (Kiveris et al. 2014): each round links every node's
neighbours to its least neighbour, until nothing changes; the number of rounds grows with the logarithm
of the component sizes. A hub's neighbours are never gathered: its least neighbour comes from a
pre-aggregated minimum that is joined back, and Spark may split the hub's side of that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the least of its component; both longs.
    Self links, repeated links and links with a null end are ignored; no links: no rows."""
    links = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    before, turn = None, 0
    while True:
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.least("m", "x").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        turn += 1
        links = scratch.keep(small.distinct(), f"{name}{turn}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{turn - 1}")
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
