"""Connected components by alternating stars: links stay distributed, each round is cut off in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import stage_table


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node that it knows."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage_table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")  # read anew, so that a join can split a hub
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    least = stage_table(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    passed = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return passed.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long), any direction. Returns node, root for each linked node; root is the smallest of its component.

    Null ends and loops are no links; repeated links count once; without links there are no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = stage_table(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    seen = None
    while True:
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == seen or not told[0]:
            break
        seen = told
        now = stage_table(_small_star(_large_star(now)), "links")
    roots = now.select(a.alias("node"), b.alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
