"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.scratch import materialized


def _smallest(both: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each component, for all nodes of ``links(a, b)``.

    Every round replaces each link by two at most, and rounds are logarithmic in the longest path. A node with very many links is a hot
    join key on one side only. Each round's links are written, so a lost executor repeats one round at most. Null ends are left out.
    """
    nodes = links.filter("a is not null and b is not null").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = materialized(nodes.distinct(), "links")
    while True:
        both = edges.filter("u != v").unionByName(edges.filter("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = _smallest(edges).filter("m < u").select("u", F.col("m").alias("v"))
        # Large-star keeps a path from every node to its smallest neighbour.
        large = materialized(large.unionByName(own).distinct(), "large-star")
        down = _smallest(large)
        small = (
            large.join(down, "u").select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.filter("m < u").select("u", F.col("m").alias("v")))
            .distinct()
        )
        fresh = materialized(small, "small-star")
        # Done when every node has one link, to a node that has none upwards.
        ups = fresh.groupBy("u").count().filter("count > 1").limit(1).count()
        chains = 0 if ups else fresh.join(fresh.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        edges = fresh
        if not ups and not chains:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    lone = nodes.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("label"))
    known = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
    return known.unionByName(lone).groupBy("node").agg(F.min("label").alias("label"))
