"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import store


def _star_sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. Nodes without a link have no row.

    Every round moves the larger neighbours of a node to its smallest neighbour, then
    the smaller ones; rounds grow with the logarithm of the size of a component. Minima
    combine before the shuffle, and they are stored, so that a node with very many
    links is a plain join that adaptive execution splits. Loops and nulls are ignored.
    """
    x, y = F.col(a), F.col(b)
    pairs = links.filter(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    edges = store(pairs.distinct(), "edges")
    before = None
    while (now := _star_sum(edges)) != before:
        before = now
        ends = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = store(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = edges.join(least, edges["lo"] == least["u"]).select("hi", F.col("m").alias("lo"))
        edges = store(large.distinct(), "large-star")
        least = store(edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "least")
        small = edges.join(least, edges["hi"] == least["u"])
        moved = small.filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        edges = store(moved.union(stars).distinct(), "small-star")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select("lo", "lo").distinct()
    )
