"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultgauge.llm.common import written


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Each node hands the least of its neighbourhood to its larger (large star) or smaller (small star) neighbours."""
    if small:
        sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    # a hot centre is summed up before the shuffle; its links are split by the skew join
    joined = sides.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    else:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is named after its least node.

    Links of a node with itself, repeated ones and their directions do not matter. The table of each round is
    written to the shared folder; only a count and a checksum of it reach the driver.
    """
    current = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        current = written(_stars(_stars(current, small=False), small=True), "links")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    # every link now leads from a node to the least of its component
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select("b", "b").distinct()
    )
