"""What the plans share: tables, and views of the test tables as images, candidates and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgraph.operators import select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, q: each embedding as an 8 x 8 gray raster of 64 samples, row by row."""
    sample = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 512 + 128.5).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", sample).alias("q"))


RASTER = """r AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, floor(x::DOUBLE * 512 + 128.5)))::INT) AS q
  FROM embeddings)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, ordinal, size, lossy, pending, score: each line item as a candidate encoding of its order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.row_number().over(order).alias("ordinal"),
        F.floor(F.col("l_extendedprice") / 1000).alias("size"),
        (F.col("l_returnflag") == "R").alias("lossy"),
        (F.col("l_linestatus") == "O").alias("pending"),
    )
    return rows.withColumn("score", select.score(F.col("size"), F.col("lossy"), F.col("pending")))


CANDIDATES = """cand AS (SELECT *, size * (CASE WHEN lossy THEN 110 ELSE 100 END) * (CASE WHEN pending THEN 96 ELSE 100 END) AS score FROM (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS ordinal,
    floor(l_extendedprice / 1000)::BIGINT AS size, l_returnflag = 'R' AS lossy, l_linestatus = 'O' AS pending FROM lineitem))"""


def cents(c: Column) -> Column:
    """Money as whole cents, so that sums don't depend on their order."""
    return F.floor(c * 100 + 0.5).cast("long")
