"""Connected components by a distributed union-find: links are rewired towards the smallest id nearby until every
component is a star around its smallest id. Only joins and aggregates over the links; none of them goes to the driver.
A node with very many links is pre-aggregated before each shuffle, and the joins by node may be split by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def stars(links: DataFrame) -> bool:
    """Whether every component is a star around its smallest id: each id has one link at most, and none that others have one to."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of one orderable type, in any order, repeated or not. Returns (id, component) for each id that is linked
    to another; component is the smallest id that it reaches. Ids without links, and links of an id to itself, are left out."""
    links = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not stars(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = keep(down.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
