"""Connected components over edges that may be too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.skew import met
from leafgraph.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): component is the smallest node that can be reached.

    Alternates two rounds until nothing changes, in a number of rounds about the logarithm of the longest path:
    every node hangs its larger neighbours on its smallest one (large star), then its smaller ones (small star).
    Neighbours are never gathered: minima are combined before each shuffle, and nodes with very many neighbours are met where the edges are. Each round is a written table.
    """
    now = written(_ordered(edges.select("a", "b")), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        large = met(both.where("b > a"), least, "a", F.col("n"), 2 * mark[0])
        large = written(_ordered(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))), "edges")
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        hung = met(large, small, "a", F.col("n"), large.count()).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(_ordered(hung.unionByName(small.select("a", F.col("m").alias("b")))), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node a to the smaller b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
