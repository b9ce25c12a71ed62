"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import lookup
from skein.session import cut_lineage


def star_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, root): the smallest node of each
    component, one row per node that has a link.

    Alternating large-star and small-star steps (each a min per node and a
    join), with lineage cut after each round, until the edge table stops
    changing; the number of rounds grows with the logarithm of the longest
    chain. A node with more than a thousandth of all links meets its minimum by
    broadcast, so no join key is hot. Nulls, loops and repeated links don't matter.
    """
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = cut_lineage(clean)
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = lookup(both, low, "a", "n", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = lookup(large, low, "a", "n", mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells edge tables apart: their size and two sums of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.hash("a", "b").cast("long"))).first())
