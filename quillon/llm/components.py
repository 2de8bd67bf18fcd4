"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import remove, scratch

#: Links of a node from which its minimum is broadcast: there are at most twice as many such nodes as there are links over this.
HEAVY = 100_000


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, least): each link with the least b of its a. Minima are aggregated before they are shuffled; links of heavy nodes aren't shuffled at all."""
    stats = edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
    heavy = F.broadcast(stats.where(F.col("n") > HEAVY).select(F.col("a").alias("heavy"), "least"))
    here = F.col("a") == F.col("heavy")
    rest = edges.join(heavy.select("heavy"), here, "left_anti").join(stats.where(F.col("n") <= HEAVY).select("a", "least"), "a")
    return edges.join(heavy, here).select("a", "b", "least").union(rest.select("a", "b", "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    return down.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link but its component's smallest node; links: (a, b), a <> b.

    Each round is written to the shared folder, in place of the one before, until every node has one link, to a node that has none to a smaller one.
    """
    spark, path = links.sparkSession, scratch(links.sparkSession, "links")
    links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(path)
    while True:
        edges = spark.read.schema("a bigint, b bigint").parquet(path)
        ways = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        inner = edges.select(F.col("b").alias("a")).distinct().join(ways.select("a"), "a", "left_semi")
        if ways.where("n > 1").select("a").union(inner).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last, path = path, scratch(spark, "stars")
        _small_star(_large_star(edges)).write.parquet(path)
        remove(spark, last)
