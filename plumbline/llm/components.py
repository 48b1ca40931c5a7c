"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another node; root is the smallest node of its component.

    Alternates the two star contractions until the links no longer change: first every node's larger neighbours are
    attached to its smallest neighbour, then its smaller ones. The links never grow in number and each round is two
    aggregations and two joins whose intermediate result is written to the shared folder, so a hub with very many
    links is never gathered in one place. Null ends are ignored; no link is an empty result."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges, "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark.n == 0 or (mark.n, mark.h) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        seen = (mark.n, mark.h)
        both = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"))
        lowest = both.select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(lowest, "v").select("u", F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(edges, "small-star")
