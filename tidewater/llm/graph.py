"""Connected components of a large graph, as DataFrame joins (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge; component: the least node id reachable. Ids are longs.

    Each round ties every node to the least neighbour it knows, larger ones first (large star), then smaller ones (small
    star); after O(log^2 n) rounds every component is a star around its least node and nothing changes. Minima are
    aggregated before they cross the network and joins on hot nodes are left to adaptive skew handling. Each round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    before = _digest(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), e
        discard(old)
        now = _digest(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1000003))).first())
