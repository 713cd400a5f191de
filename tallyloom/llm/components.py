"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom import session


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(rows: DataFrame, keep: str) -> DataFrame:
    """Point the neighbours of each node that ``keep`` selects at the smallest node around it."""
    least = rows.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")).select(
        "_a", F.least("_a", "m").alias("m"))
    joined = rows.join(least, F.col("a") == F.col("_a"))
    return joined.filter(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b) links; the component is its smallest node.

    Each round is two joins of the links with their smallest neighbours; a hub with very many
    links is summed up before the shuffle, and its rows are split in the join. Rounds grow with
    the logarithm of the longest path. Links are written between rounds and never reach the
    driver, which only compares two sums. Links may repeat and point either way; a link of a node to itself
    names no node, nor does one with a null end, and no links give no rows. Nodes may be of any type with an order.
    """
    def sums(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = session.settle(links.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = sums(current)
    while True:
        large = _star(_both(current), "b > a").filter("a != b").distinct()
        # small star: neighbours below a node, and the node itself, point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        current = session.settle(small, "links")
        after = sums(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
