"""Scoring candidate encodings and choosing the smallest acceptable one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed values, in hundredths: a lossy candidate must be a tenth smaller; an estimate can still shrink by 4 %.
LOSSY, PENDING, WHOLE = 110, 96, 100
#: Candidates within 15 % of the lowest score are worth compressing for real.
SHORTLIST = 115
#: Bytes that a replacement must save: images, other streams.
IMAGE_MARGIN, STREAM_MARGIN = 16, 8


def score(size: Column, lossy: Column, pending: Column) -> Column:
    """size * 1.10 if lossy * 0.96 if pending, in ten-thousandths: whole numbers compare exactly."""
    return size * F.when(lossy, LOSSY).otherwise(WHOLE) * F.when(pending, PENDING).otherwise(WHOLE)


def best(candidates: DataFrame, key: str) -> DataFrame:
    """The candidate of the lowest score of each key; of equal scores the first by ordinal."""
    names = [c for c in candidates.columns if c != key]
    first = F.min_by(F.struct(*names), F.struct("score", "ordinal")).alias("best")
    return candidates.groupBy(key).agg(first).select(key, "best.*")


def shortlist(candidates: DataFrame, key: str) -> DataFrame:
    """The candidates within SHORTLIST hundredths of their key's lowest score: the ones to compress in earnest.

    The filter lies below whatever is applied to its result, so the expensive step sees the shortlist only.
    """
    least = F.min("score").over(W.partitionBy(key))
    return candidates.withColumn("lowest", least).where(F.col("score") * 100 <= F.col("lowest") * SHORTLIST)


def accepted(new: Column, old: Column, margin: int = IMAGE_MARGIN) -> Column:
    return new + margin < old


def saved(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), before - after)


def saved_fraction(before: Column, after: Column) -> Column:
    return F.when(before > 0, saved(before, after) / before).otherwise(F.lit(0.0))
