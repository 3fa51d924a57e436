"""Connected components of a link table, as Spark jobs: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); the root is the smallest node of the component.

    Every round hangs the larger neighbours of a node on its smallest neighbour, then the smaller ones, until every
    link leads straight to the smallest node of its component. The rounds grow with the logarithm of the longest
    path. Links stay in Spark and each step is a written table; smallest neighbours are written before they are
    joined, so that the join of a node with very many links can be split.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = cut_lineage(links.distinct(), "links")
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        near = cut_lineage(both.join(cut_lineage(least, "least"), F.col("a") == F.col("u")).select("a", "b", "m"), "near")
        if near.where(F.col("m") != F.least("a", "b")).isEmpty():
            break
        large = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"])
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
        links = small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        links = cut_lineage(links, "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
