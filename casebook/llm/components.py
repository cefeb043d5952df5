"""Connected components of a graph given as a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b); root is the smallest node it reaches.

    Alternates two steps until nothing changes: every node tells its larger neighbours, then its
    smaller ones, of the smallest node near it. Steps are aggregations and joins on the node, so a
    node with very many links is summed before it is shuffled. The sums are written before they are joined
    back, so both sides of the join are plain reads and a crowded node's partition can be split. Each round
    is written to the shared folder.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    before = None
    while True:
        links = written(_star(_star(links, larger=True), larger=False), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select("b", "b").distinct())


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (a > b) after one step; every node also counts as its own neighbour."""
    if larger:
        sides = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = links
    least = written(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    near = sides.join(least, "a")
    if larger:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()
