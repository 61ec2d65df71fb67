"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm.scratch import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected links (a, b); component is its smallest node.

    Alternating large-star and small-star steps, which need a number of rounds
    that grows with the logarithm of the longest chain.  Self-links name nodes only.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = _mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        e = stage(small)
        after = _mark(e)
        if after == before:
            break
        before = after
    return (nodes.join(e, nodes["node"] == e["u"], "left")
            .select("node", F.coalesce("v", "node").alias("component")))


def _mark(e: DataFrame) -> tuple[int, int | None, int | None]:
    """Number of links and two digests of their set."""
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(r)
