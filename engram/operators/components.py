"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import cut


def components(links: DataFrame, src: str, dst: str, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """((node, component), the links as used): component is the smallest node that can be reached.

    Alternating large-star and small-star steps: each keeps the components and roughly halves their depth, so the
    number of rounds is logarithmic. Every round's links are checkpointed in the shared folder (lineage is cut, the
    loss of an executor is survived); the driver sees one number a round, the links' checksum. Links of a node with
    itself and repeated ones don't matter. Stars are built with aggregates and joins, a hub's neighbours are never
    collected into a row. Raises if ``rounds`` don't suffice.
    """
    start = cut(links.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).where("src < dst").distinct())
    edges, before = start, None
    for _ in range(rounds):
        # Large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours.
        both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x > m").unionByName(low.select(F.col("u").alias("x"), "m"))
        edges = cut(small.select(F.col("m").alias("src"), F.col("x").alias("dst")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    labels = edges.select(F.col("dst").alias("node"), F.col("src").alias("component"))
    return labels.unionByName(edges.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()), start
