"""Reachability, unreferenced objects and reference rewriting over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.session import written


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): every node that can be reached from ``roots`` (node) over ``edges`` (src, dst), roots included at
    depth 0, with its least depth. Cycles are safe: a frontier holds only nodes not seen before. Each level joins the
    frontier alone with the edges, and is a written table; the rounds are as many as the longest shortest path.
    """
    seen = [written(roots.select("node").dropna().distinct().withColumn("depth", F.lit(0)), "frontier")]
    while max_depth is None or len(seen) <= max_depth:
        known = seen[0]
        for level in seen[1:]:
            known = known.unionByName(level)
        step = (
            seen[-1]
            .join(edges.select(F.col("src").alias("node"), "dst"), "node")
            .select(F.col("dst").alias("node"))
            .dropna()
            .distinct()
            .join(known, "node", "left_anti")
            .withColumn("depth", F.lit(len(seen)))
        )
        step = written(step, "frontier")
        if step.isEmpty():
            break
        seen.append(step)
    out = seen[0]
    for level in seen[1:]:
        out = out.unionByName(level)
    return out


def unreferenced(objects: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    """Objects that nothing refers to; null references refer to nothing."""
    return objects.join(references.select(F.col(ref).alias(key)).distinct(), key, "left_anti")


def rewritten(rows: DataFrame, ref: str, mapping: DataFrame) -> DataFrame:
    """``rows`` with ``ref`` replaced where ``mapping`` (old, new) has it; unmapped references stay."""
    names = rows.columns
    met = rows.join(mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(ref) == F.col("_old"), "left")
    return met.withColumn(ref, F.coalesce("_new", ref)).select(*names)
