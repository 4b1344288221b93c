"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and an equi-join, so a node with many links never gathers
its links in one task, and the links stay distributed throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stage


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


# Minima are written before they are joined: a join of two plain exchanges can be split where one node has most links.


def _kept(df: DataFrame, label: str, paths: list[str]) -> DataFrame:
    table, path = stage(df, label)
    paths.append(path)
    return table


def _large_star(links: DataFrame, paths: list[str]) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", paths)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")


def _small_star(links: DataFrame, paths: list[str]) -> DataFrame:
    links = _kept(links, "stars", paths)
    least = _kept(links.groupBy("u").agg(F.min("v").alias("m")), "least", paths)
    joined = links.join(least, "u")
    moved = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """links (u long, v long) -> (node, root): every node that has a link, and the least node of its component.

    Self links and repeated links are allowed; direction does not matter. No links: no rows.
    """
    spark = links.sparkSession
    tidy = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now, path = stage(tidy, "links")
    seen = _signature(now)
    while seen[0]:
        used = [path]
        after, new = stage(_small_star(_large_star(now, used), used).distinct(), "links")
        discard(spark, *used)
        now, path = after, new
        if (sign := _signature(now)) == seen:
            break
        seen = sign
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
