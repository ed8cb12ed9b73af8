"""Connected components of a link table by alternating large-star and small-star.

Links stay in tables; each round is two joins with map-side minima, written to
the shared folder.  Only whether a round is left to do reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import drop, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b) with a > b.

    Large-star hangs every larger neighbour of a node on the smallest node around it;
    small-star hangs the smaller neighbours and the node itself on the smallest.
    """
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        hung = links.join(least, "a")
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one other node that itself hangs on none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("under")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("under")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("under").alias("under")).where("up > 1 or up = 1 and under = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each linked node reaches; links are (a, b) of longs.

    Null ends and loops link nothing.  An empty link table gives an empty result.  Rounds go on
    until only stars are left, whatever their number (about log² of the longest chain); every
    link points to the smaller node, so a star's centre is its smallest.  Earlier components
    given as links (node, label) beside new links spare the rounds that made them.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        before, now = now, written(_star(_star(now, True), False), "stars-round")
        drop(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
