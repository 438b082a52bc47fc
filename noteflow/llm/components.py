"""Connected components of a links table, by alternating stars on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the component's smallest node) of all nodes that ``links(a, b)`` names.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour, until nothing changes. Minima fold before their shuffle and join back on the
    node, so a node with very many neighbours is never gathered. Every round is written, so
    a lost executor costs one round at most.
    """
    links = written(
        links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "links"
    )
    before = None
    while True:
        larger = _star(links, links.select("low", "high").union(links.select("high", "low")).toDF("node", "other"), True)
        smaller = _star(larger, larger.select("high", "low").toDF("node", "other"), False)
        links = written(smaller, "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    # the smallest nodes themselves belong to their own component
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )


def _star(links: DataFrame, sides: DataFrame, larger: bool) -> DataFrame:
    """Links from each node's smallest neighbour to its larger (or smaller) neighbours."""
    smallest = sides.groupBy("node").agg(F.min("other").alias("least"))
    smallest = smallest.select("node", F.least("node", "least").alias("least"))
    kept = sides.where("other > node") if larger else sides
    moved = kept.join(smallest, "node").select(F.col("least").alias("low"), F.col("other").alias("high"))
    if not larger:
        moved = moved.union(smallest.select(F.col("least").alias("low"), F.col("node").alias("high")))
    return moved.where("low < high").distinct()
