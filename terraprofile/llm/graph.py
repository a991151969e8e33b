"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraprofile.session import materialize


def components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): node and component, the smallest node it reaches.

    Stars are drawn around the smallest neighbour in turn, from above and from below, until
    nothing changes; rounds grow with the logarithm of the longest path. Each round is a
    written table. Minima are taken in the tasks first, so a node of many links is no burden.
    """
    stars = materialize(_ordered(links.select("a", "b")), "links")
    seen = None
    while True:
        found = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == seen or not found[0]:
            break
        seen = found
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        stars = materialize(_ordered(small), "links")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
