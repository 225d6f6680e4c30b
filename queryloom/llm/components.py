"""Connected components of an edge table, by min-label stars with alternating steps.

Large-star and small-star rounds (Kiveris et al., 2014): each round is two shuffles of
at most the edges there are, the number of rounds is logarithmic in practice, and the
table is cut by a checkpoint each round. Hot nodes are aggregated before the shuffle
by a minimum, so a star of any degree never meets in one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryloom.llm._common import checkpoint


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b) to (node, root): root is the smallest node reachable, for every node with an edge."""
    pairs = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u is joined to the least of u's neighbourhood.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are joined to the least of them.
        small = big.groupBy("u").agg(F.min("v").alias("m"))
        moved = big.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpoint(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components: no fixed point")
    return pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(pairs.select("v", "v").toDF("node", "root").distinct())
