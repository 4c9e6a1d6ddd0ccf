"""Connected components by alternating star contraction, on DataFrames alone.

Every round links each node's larger neighbours to its smallest one, then the node and its smaller neighbours to
the smallest of them. The graph becomes stars whose centres are the smallest nodes, in a number of rounds that grows
with the logarithm of the graph. Minima combine on the map side; the joins back are plain equi-joins, which adaptive
execution splits where one node holds many links. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.shared import discard, materialise


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links hold the larger node in a."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a long, b long): the component is its smallest node."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "links")
    before = _state(links)
    while before[0]:
        previous, links = links, materialise(_small_star(_large_star(links)), "links")
        discard(previous)
        now = _state(links)
        if now == before:
            break
        before = now
    # every larger node now points at its centre; centres point at themselves
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
