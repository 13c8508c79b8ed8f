"""Plans over codecs: q56 to q59; SQL can't express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions import udfs
from leafgraph.operators import select
from leafgraph.plans.base import raster as rasters
from leafgraph.plans.base import table

SQL: dict[str, str] = {}


def q56_flate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    rows = udfs.once(docs, "data", "size", lambda c: F.octet_length(udfs.deflated(c)))
    before = F.octet_length("data")
    return rows.select("doc_id", before.alias("before"), F.col("size").alias("after"), select.accepted(F.col("size"), before, select.STREAM_MARGIN).alias("replaced"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.transform("q", lambda v: F.lpad(F.hex(v), 2, "0"))
    return rasters(spark, sf_dir).select("vec_id", F.unhex(F.array_join(hexed, "")).alias("data"))


def q57_png_flate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.octet_length(udfs.deflated(c))
    rows = _packed(spark, sf_dir).withColumn("predicted", udfs.png_predicted("data", F.lit(8)))
    return rows.select("vec_id", size("data").alias("plain"), size("predicted").alias("predicted"))


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("vec_id", F.transform("q", lambda v: F.when(v < 128, 1).otherwise(0)).alias("bits"))


def q58_g4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir).select("vec_id", udfs.g4_round_trip("bits", F.lit(8)).alias("r")).select("vec_id", "r.size", "r.same")


def q59_jbig2_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir).select("vec_id", udfs.jbig2_round_trip("bits", F.lit(8)).alias("r")).select("vec_id", "r.size", "r.same")
