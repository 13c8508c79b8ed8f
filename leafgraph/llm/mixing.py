"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The group of all sources without a weight of their own, null among them.
REST = "*"
#: u is a whole number of 2**-52: exact in a double.
HEX, STEPS = 13, 16**13


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``:``; the same on any engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("long").cast("double") / F.lit(float(STEPS))


#: A larger mean is the sum of equal parts of at most this, each with a number of its own.
PART = 32.0


def poisson_steps(mean: float) -> list[float]:
    """The distribution function of Poisson(mean) at 0, 1, 2, ... until no u below 1 lies beyond it."""
    steps, term, total, k = [], math.exp(-mean), math.exp(-mean), 0
    while total < 1 - 2.0**-53 and k < 40 + 12 * mean:
        steps.append(total)
        k += 1
        term *= mean / k
        total += term
    return steps


def rates(docs: DataFrame, weights: dict[str, float], size: int | None = None) -> dict[str, float]:
    """Mean copies of a document by source, so that the mix has ``size`` documents (None: as many as there are)
    with shares as ``weights``. Sources that are not in ``weights`` share the weight of REST."""
    if any(w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be 0 or more, and some above 0")
    counted = docs.groupBy(group(F.col("source"), weights).alias("g")).count().collect()  # no more rows than weights
    n = {r["g"]: r["count"] for r in counted}
    total, whole = sum(n.values()), sum(w for g, w in weights.items() if n.get(g))
    return {g: (size if size is not None else total) * weights.get(g, 0) / whole / c if whole else 0.0 for g, c in n.items()}


def group(source: Column, weights: dict[str, float]) -> Column:
    own = [s for s in weights if s != REST]
    return F.when(source.isin(own), source).otherwise(F.lit(REST)) if own else F.lit(REST)


def mixed(docs: DataFrame, weights: dict[str, float], size: int | None = None, seed: int = 0) -> DataFrame:
    """Each document as often as a Poisson number with its source's mean says, all in a global random order.

    The number inverts the Poisson distribution at a hash of seed and doc_id, so a lost task makes the same rows again
    and rows of one doc_id get the same number. Adds copy (from 1) and shuffle_key (hex, order by it): rows are
    dealt to partitions by a hash of shuffle_key and sorted by it within each, so each partition is a random sample
    of all sources, whatever their sizes. A null doc_id hashes as ``null``, a null source belongs to REST; empty tables
    give no rows. All columns of ``docs`` stay; ones named copy or shuffle_key are replaced.
    """
    means = rates(docs, weights, size)
    docs = docs.drop("copy", "shuffle_key")
    times = F.lit(0)
    g = group(F.col("source"), weights)
    for name, mean in sorted(means.items()):
        parts = max(1, math.ceil(mean / PART))
        steps = F.array(*map(F.lit, poisson_steps(mean / parts)))
        passed = F.lit(0)
        if mean:  # each part's number is how many steps its u has passed
            passed = F.aggregate(
                F.sequence(F.lit(1), F.lit(parts)),
                F.lit(0),
                lambda n, part: n + F.size(F.filter(steps, lambda s: s <= unit(F.lit(seed), F.col("doc_id"), part))),
            )
        times = F.when(g == F.lit(name), passed).otherwise(times)
    # counted from 0, as a sequence from 1 to 0 would run backwards
    copies = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).where("copy > 0")
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    copies = copies.withColumn("shuffle_key", key)
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
