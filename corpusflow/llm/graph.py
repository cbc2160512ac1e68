"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.llm import helpers


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links(a, b)``; root is the smallest node reachable.

    Each step joins the links with one minimum per node, so a node with very
    many links is pre-aggregated, and its joined rows can be split by the
    engine.  Links are rewritten, never multiplied; the steps end when the
    links form stars.  Links with a null end, and of a node with itself, are passed over.
    """
    scratch = helpers.Scratch(links.sparkSession)
    edges = scratch.keep(links.select("a", "b").filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, turn = None, 0
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = scratch.keep(small, f"links{(turn + 1) % 2}")
        scratch.drop("links", f"links{turn % 2}")       # two tables are there at a time
        turn += 1
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
