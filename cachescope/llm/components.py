"""Connected components of an edge table, by alternating large and small stars.

Each round first links every node's larger neighbours to its smallest neighbour and
then its smaller ones, until the graph is a forest of stars. Only minima are aggregated
(combined map-side), so a node with very many neighbours is no single task's work but
for narrow rows of a join that Spark can split. Every round is written to the shared
folder: plans stay one round deep and a lost executor costs no more than the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: its size and the sum of its rows' hashes."""
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the smallest node of the component, for every node with an edge.

    ``edges`` has two bigint columns; loops and nulls are ignored.
    """
    now = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                  .where(F.col("u") > F.col("v")).distinct(), "edges")
    mark = _print(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join shuffles both sides by itself and can split a node of very many
        # neighbours; a grouped side would have to stay in one piece
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.join(least, "u").where(F.col("v") > F.col("u"))
                        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # each smaller neighbour, and the node itself, to the smallest one
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = written(small, "edges")
        mark, last = _print(now), mark
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
