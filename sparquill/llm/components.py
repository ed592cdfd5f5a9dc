"""Connected components of links, as DataFrames all the way.

Alternating large-star and small-star rounds: each keeps the components as they are and brings every
node nearer to the smallest of its component; the links end as stars. Each round's table is written to
the shared folder, so a lost executor costs a task, not the rounds before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Stored links (a > b). Large: greater neighbours move to the least one; small: the others do.

    The least neighbours are a table of their own, so that both sides of the join are plain shuffles and Spark can split
    the node that a third of all links may share.
    """
    if large:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = common.stored(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    joined = near.join(least, "u")
    moved = joined.where("v > u") if large else joined
    moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    moved = moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    moved = common.stored(moved, "stars")
    common.discard(least)
    return moved


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long), in any order, to (node, root): every linked node and the smallest node of its component."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = common.stored(links, "links"), None
    while True:
        half = _star(links, True)
        whole = _star(half, False)
        common.discard(links, half)
        links = whole
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
