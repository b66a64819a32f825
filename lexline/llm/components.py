"""Connected components of a link table, by alternating large and small stars.

Every step is a grouped minimum and a join on narrow rows; nothing comes to the driver but one
flag a round. A star takes all neighbours of a node to the smallest of them, so chains shrink
by halves and rounds grow with the logarithm of the longest one. It ends when every node that has
an edge is either a centre or has one edge, to a centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexline.session import durable


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """(u, v) to (v, smallest of u and its v), for all v and for u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has either edges to it or a single one from it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return sums.where("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``links`` (a, b) can reach.

    Links may repeat, run either way, or join an id with itself; ids without links are not in the
    result. Null ends are left out.
    """
    edges = durable(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # ``large`` runs from greater to smaller ids, so a node's v are its smaller neighbours.
        small = _to_smallest(large)
        edges = durable(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
