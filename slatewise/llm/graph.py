"""Connected components of a table of links, without collecting links or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (columns a, b) can reach.

    Large-star and small-star steps alternate: each node's neighbours are linked to the smallest of them
    until every component is a star around its smallest node.  A step is a minimum per node, combined
    before the shuffle, and a join back, so that a node with very many links is split by adaptive execution.
    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("b"), "a")
        small = small.select(F.explode(F.array(F.struct("x", "b"), F.struct(F.col("a").alias("x"), "b"))).alias("e"))
        edges = checkpointed(small.select(F.col("e.x").alias("a"), F.col("e.b").alias("b")).filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first()
        # done when nothing moved and each node has one link, which leads to its root
        if now == state and now[0] == now[2]:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
