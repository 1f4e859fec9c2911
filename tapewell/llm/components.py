"""Connected components of links between ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id that occurs in ``links`` (a, b) with the smallest id it can reach.

    Each round hangs the neighbours of every id on its smallest neighbour, from above and then from below; the
    number of rounds follows the logarithm of the longest chain.  Rounds are written tables, so a lost executor
    costs one round.  Only a count and a checksum come to the driver.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    given = links.where(a.isNotNull() & b.isNotNull())
    edges = checkpointed(given.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = down.groupBy("hi").agg(F.min("lo").alias("m"))
        up = down.join(root, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = checkpointed(up.union(root.select("hi", F.col("m").alias("lo"))).distinct())
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
