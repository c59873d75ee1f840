"""Connected components by alternating large and small stars.

Each round is two aggregations and joins by key.  A node of very many edges is pre-aggregated for its
minimum, and the join that follows meets one row for it, so that Spark may split its partition.  No
edge or component reaches the driver; it sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.llm.shared import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with an edge to another: root is the smallest id reachable."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = stored(now, "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if (after := mark(now)) == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
