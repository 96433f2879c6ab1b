"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import forget, settle


def component_labels(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long); label is the component's smallest node.

    Large-star and small-star steps alternate until the edges stay the same. Each
    step groups by node with a map-side minimum and joins the minimum back, so a
    hub costs no more than its edges; only a count and a checksum reach the driver.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = settle(edges.distinct(), name)
    last = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == last or not state[0]:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
        last = tuple(state)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(
            small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        before, edges = edges, settle(small.distinct(), name)
        forget(before)
