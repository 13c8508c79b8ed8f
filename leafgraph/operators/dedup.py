"""Merging identical objects: survivors, and what the copies waste."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(objects: DataFrame, key: str, content: list[Column]) -> DataFrame:
    """(key, survivor): the smallest key with the same content.

    Contents meet by SHA-256 of their parts with the lengths, so that the shuffle moves digests and keys only.
    """
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (p.cast("string") for p in content)]
    rows = objects.select(F.col(key), F.sha2(F.concat_ws("|", *parts), 256).alias("digest"))
    least = rows.groupBy("digest").agg(F.min(key).alias("survivor"))
    return rows.join(least, "digest").select(key, "survivor")


def replacements(found: DataFrame, key: str) -> DataFrame:
    """(old, new) of the objects that another one replaces."""
    return found.where(F.col(key) != F.col("survivor")).select(F.col(key).alias("old"), F.col("survivor").alias("new"))
