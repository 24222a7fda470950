"""Connected components of a link table, by alternating large-star and small-star steps.

All work is shuffled aggregation and joins on link tables in the shared folder; nothing is
collected. Each round at least halves the distance to the root for most nodes, so that rounds
grow with the logarithm of the longest path. Hub nodes meet a map-side minimum first, and the
join back to their links is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import discard, stash


def _stars(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links of each node to its smallest neighbour; ``links`` has a > b, rows (a, b)."""
    around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        around = around.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if both_ways:  # large star: larger neighbours go to the minimum
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # small star: the node and its smaller neighbours do
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) of one orderable type. Returns (node, root) for every node with a link, a table in files."""
    now = stash(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
        before, now = now, stash(_stars(_stars(now, True), False), "links")
        discard(before)
    ends = F.array(F.col("a"), F.col("b"))
    roots = stash(now.select(F.explode(ends).alias("node"), F.col("b").alias("root")).distinct(), "roots")
    discard(now)
    return roots
