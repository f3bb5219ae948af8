"""Connected components of an edge table by alternating star contraction, every step a distributed join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the undirected edges; root is the least node of its component, itself included.

    Large-star hangs each node's larger neighbours on its least neighbour, small-star does so with the smaller ones;
    the edge set shrinks to one star for each component. Minima are written out before they are joined back, so that both sides
    of a join are plain shuffles, which Spark splits where one hub has very many neighbours. Null and equal ends are ignored.
    """
    x, y = F.col(a), F.col(b)
    e = staged(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "cc")
    last = None
    # a round's tables go when the next round's edges are written
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "cc-large")
        discard(least, e)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        met = large.join(least, "u")
        small = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        e = staged(small, "cc")
        discard(large, least)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0])
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
