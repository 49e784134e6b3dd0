"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.staging import staged

#: Rounds after which the loop gives up with an error; the steps need O(log^2 n) rounds.
MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (u bigint, v bigint) whose component is not itself.

    ``component`` is the smallest node reachable. Self-loops, repeated and reversed edges and nulls are harmless;
    no edges give no rows. Every step is a keyed aggregation and join; nothing is collected but a checksum.
    """
    both = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = staged(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    last = _signature(now)
    for k in range(1, MAX_ROUNDS + 1):
        if last[0] == 0:
            break
        # large star: every neighbour above u points at the smallest node around u
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written first: a join of two plain shuffles can split the partition of a node with many edges
        least = staged(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{k}")
        large = (
            around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        # small star: every neighbour at or below u, and u, point at the smallest of them
        large = staged(large, f"large{k}")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"low{k}")
        small = (
            large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = staged(small, f"edges{k}")
        seen = _signature(now)
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
