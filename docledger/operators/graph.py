"""Connected components by alternating large-star and small-star rounds.

Edges are kept as (larger, smaller). A round is an aggregate and a join whose one side
is unique by key, so a hub node is pre-aggregated before the shuffle and its edge rows
can be split by AQE's skew-join handling. The number of rounds is logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.plans.storage import discard, materialize


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` for every node that has an edge.

    ``root`` is the smallest node reachable. Self loops and nulls are ignored,
    repeated edges count once, an empty input gives an empty result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialize(e.where(F.col("u") > F.col("v")).distinct(), tag)
    last = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or mark[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
        last = mark
        # stored, so that both sides of a join are plain shuffles, whose hot keys AQE can split
        low = materialize(e.groupBy("u").agg(F.min("v").alias("m")), tag)
        up = low.select(F.col("u").alias("v"), "m")
        large = materialize(e.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), tag)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        spent = [low, large, least]
        done, e = e, materialize(small.union(least.select("u", "m")).distinct(), tag)
        for x in [done, *spent]:
            discard(x)
