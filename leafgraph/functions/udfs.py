"""Codecs as Arrow-batched column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgraph.functions import codecs

TRIP = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("same", T.BooleanType())])


@F.pandas_udf(T.BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    return data.map(codecs.deflate, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def inflated(data: pd.Series) -> pd.Series:
    return data.map(codecs.inflate, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def png_predicted(data: pd.Series, row_bytes: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else codecs.png_predict(d, int(n)) for d, n in zip(data, row_bytes)])


def _rows(samples, width: int) -> list[list[int]]:
    bits = [int(v) for v in samples]
    return [bits[i : i + width] for i in range(0, len(bits), width)]


@F.pandas_udf(TRIP)
def g4_round_trip(samples: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = []
    for bits, w in zip(samples, width):
        rows = _rows(bits, int(w))
        data = codecs.g4_encode(rows, int(w))
        out.append((len(data), codecs.g4_decode(data, int(w), len(rows)) == rows))
    return pd.DataFrame(out, columns=["size", "same"])


@F.pandas_udf(TRIP)
def jbig2_round_trip(samples: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = []
    for bits, w in zip(samples, width):
        rows = _rows(bits, int(w))
        data = codecs.jbig2_encode(rows, int(w))
        out.append((len(data), codecs.jbig2_decode(data) == rows))
    return pd.DataFrame(out, columns=["size", "same"])


def once(rows: DataFrame, content: str, result: str, function) -> DataFrame:
    """``rows`` with ``function`` of a column, computed once for equal contents: the planner puts no distinct below a UDF by
    itself. Digests, not contents, meet in the join."""
    keyed = rows.withColumn("_digest", F.sha2(F.col(content), 256))
    distinct = keyed.groupBy("_digest").agg(F.any_value(content).alias(content))
    done = distinct.select(F.col("_digest").alias("_of"), function(F.col(content)).alias(result))
    return keyed.join(done, F.col("_digest").eqNullSafe(F.col("_of"))).drop("_digest", "_of")
