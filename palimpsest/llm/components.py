"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs to (node, component): the smallest node reachable.

    Only nodes with an edge to another node are returned.  Rows with a null end
    and self-loops are dropped; repeated pairs count once; no pairs give no
    rows.  Each round shuffles the pairs by node and is written to the
    checkpoint folder, so a lost executor costs one round at most.
    The number of rounds grows with the logarithm of the longest chain.
    """
    now = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(others.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    rows = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = rows.select(F.col("component").alias("node"), "component").distinct()
    return rows.unionByName(roots)
