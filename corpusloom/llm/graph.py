"""Connected components of a graph of links, by alternating star operations on its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node reachable) of every node in links(a, b), both longs.

    Each round points every node at the smallest node among its neighbours (large star, then small star), so paths
    shorten by half or better. Neighbourhoods are only ever reduced to their minimum, which Spark combines before the
    shuffle, and joined back; no group is gathered, and no edge comes to the driver: the joins are merges, however small Spark
    takes a side to be, as a table of longs is many times its Parquet files once the driver has it as a hash relation.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = saved(edges)
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last, mark = mark, _mark(edges)
        forget(old)
        if mark == last:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
