"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import store


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for links (a, b) of longs; the root is the least node and has no row of its own.

    Hubs are no problem: a step needs only minima, which are combined before the shuffle, and joins that can be split.  Each
    round is a table in the shared folder; rounds grow with the logarithm of the longest chain.  No links give no rows.
    """
    spark = edges.sparkSession
    now, seen = store.written(edges.select("a", "b").where("a <> b").distinct(), "links"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or (state["n"], state["s"]) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (state["n"], state["s"])
        last, now = now, store.written(_small(_large(now)), "links")
        for path in last.inputFiles()[:1]:
            store.drop(spark, path.rpartition("/")[0])
