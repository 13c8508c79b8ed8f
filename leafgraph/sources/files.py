"""Finding files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators import naming


def _whole(jvm, conf, at) -> str:
    """The path as files below it are listed."""
    return at.getFileSystem(conf).makeQualified(at).toString()


def discovered(spark: SparkSession, paths: list[str], content: bool = False) -> DataFrame:
    """path, length, arg, key (and content): PDF files below each of ``paths``, recursively, hidden ones aside.

    A path that is given twice counts where it came first (arg); order by arg and key for people's order. Missing paths
    give nothing. Contents are only read where they are asked for.
    """
    found = None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for arg, path in enumerate(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(conf).exists(at):
            continue
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
        below = F.substring(F.col("path"), len(_whole(jvm, conf, at)) + 1, 2**31 - 1)  # a hidden folder above hides nothing
        rows = rows.where(~below.rlike(r"(^|/)\.")).select("path", "length", F.lit(arg).alias("arg"), *(["content"] if content else []))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "path string, length long, arg int, key string" + ", content binary" * content)
    kept = found.where(naming.is_pdf(F.col("path")))
    return naming.first_seen(kept, "path", ["arg"]).withColumn("key", naming.natural_key(F.col("path")))
