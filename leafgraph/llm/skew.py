"""Joins on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in HOT of all rows: so there are fewer than HOT hot keys.
HOT = 512


def met(rows: DataFrame, facts: DataFrame, key: str, times: Column, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, one row a key; ``times``: in how many rows the key occurs (or fewer), of ``total``.

    Facts of hot keys, fewer than HOT, are broadcast, so that the rows of such a key stay where they are; the rest meet by
    sort-merge, where no key has more than one in HOT of the rows.
    """
    hot, cold = facts.where(times * HOT > total), facts.where(times * HOT <= total)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return near.unionByName(far)
