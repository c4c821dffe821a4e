"""Connected components of a graph given by its edges, as DataFrame joins (large-star, small-star)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.session import materialize


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; ``component`` is the smallest node reachable.

    Every round hangs all larger neighbours of a node on its smallest one, then all nodes on the
    smallest of their smaller ones, until the edges are stars around the smallest nodes; the rounds
    grow with the logarithm of the longest path. A hub's edges are never gathered: its minimum is a
    partial aggregate, and the join back to its edges is one that Spark can split. Each round is
    written to the shared checkpoint folder.
    """
    cols = lambda x, y: [F.col(x).alias("hi"), F.col(y).alias("lo")]
    now = (edges.where(F.col(a) != F.col(b))
           .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    now = materialize(now, "cc")
    state = _state(now)
    while state[0]:
        both = now.select(*cols("hi", "lo")).unionByName(now.select(*cols("lo", "hi")))  # hi: centre, lo: neighbour
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = (both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .where("hi != lo").distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
                                               F.col("m").alias("lo")).where("hi != lo").distinct()
        now = materialize(small, "cc")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and two order-free fingerprints of them."""
    mix = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "hi", "lo"))
    return tuple(edges.agg(F.count(F.lit(1)), mix(1), mix(2)).first())
