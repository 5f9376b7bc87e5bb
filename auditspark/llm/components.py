"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of the
    long columns ``a``, ``b`` of ``edges``.  Self links and repeats are allowed.

    Each round links every node to the smallest of its larger-side neighbours
    (large star), then of its smaller-side ones (small star), until nothing
    changes.  All rounds are joins and grouped minima; each is written to the
    shared folder, so that no lineage grows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = written(links, "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = written(small, "small")
        now = links.agg(F.count("*"), F.sum(F.expr("pmod(xxhash64(u, v), 1000000007)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
