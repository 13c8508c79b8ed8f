"""Reports of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.operators.progress import bytes_text


def change_percent(before: Column, after: Column) -> Column:
    """Savings in whole per cent, half up; negative where files grew; null for empty ones."""
    return F.when(before > 0, F.floor((before - after) * 100.0 / before + 0.5).cast("int"))


def lines(results: DataFrame) -> DataFrame:
    """name, line: a line for each file of ``results`` (name, before, after, kept, error)."""
    shrunk = F.concat(bytes_text(F.col("before")), F.lit(" → "), bytes_text(F.col("after")), F.lit(" (−"), change_percent(F.col("before"), F.col("after")).cast("string"), F.lit("%)"))
    text = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("kept"), "already small").otherwise(shrunk)
    return results.select("name", F.concat_ws(": ", "name", text).alias("line"))


def totals(results: DataFrame) -> DataFrame:
    """One row: files, before, after, percent (of more than one file that did not fail), failed, status (0, or 1 after failures)."""
    good = F.col("error").isNull()
    sums = results.agg(
        F.count_if(good).alias("files"),
        F.coalesce(F.sum(F.when(good, F.col("before"))), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.when(good, F.col("after"))), F.lit(0)).alias("after"),
        F.count_if(~good).alias("failed"),
    )
    return sums.withColumn("percent", F.when(F.col("files") > 1, change_percent(F.col("before"), F.col("after")))).withColumn("status", F.when(F.col("failed") > 0, 1).otherwise(0))
