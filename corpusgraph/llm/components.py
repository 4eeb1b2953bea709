"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """Of links (a, b), a row (node, root) for each linked node but the roots; root is the component's smallest node.

    Each round joins a node to the smallest node it sees, first over all its neighbours, then over the smaller ones; minima are
    combined before the shuffle, and the joins have one row a node on one side, so that a node with very many links can be split.
    Every round is written to the shared folder. The links are stars of their roots once a round changes nothing.
    """
    a, b = F.col("a"), F.col("b")
    stars = write_table(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    mark = _mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = write_table(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), name)
        before, mark = mark, _mark(stars)
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 24))).first())
