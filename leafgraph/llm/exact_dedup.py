"""Exact dedup over a persistent digest index that is bucketed and sorted by hash.

A batch is reduced to one row per digest (map-side combine first, so that a digest with a third of all
rows costs one row per task), anti-joined against the index by sort-merge and appended.
DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.session import own_dir, written

BLANKS = r"[\x20\x09-\x0D]+"
#: A digest is hot if its group has more than one in HOT of the batch's rows: so there are fewer than HOT such digests.
HOT = 512


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without blanks; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, ""), 256)


class DigestIndex:
    """The digests seen so far: a table at ``path``, bucketed and sorted by digest.

    Without a path it is the application's own and goes with it. Opening an existing path continues that index;
    ``buckets`` must then be as it was. Each digest has the name of the batch that brought it, so a batch whose job failed
    can be ingested again under its name. Each append adds a file a bucket; :meth:`compacted` makes one of them.
    """

    SCHEMA = "text_sha256 STRING, keep_id BIGINT, keep_points INT, batch STRING"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.path = path or f"{own_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (text_sha256) "
            f"SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """Adds rows of SCHEMA whose digests the index does not have; one file per bucket."""
        rows = fresh.select("text_sha256", "keep_id", "keep_points", "batch").repartition(self.buckets, "text_sha256")
        rows.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compacted(self, path: str | None = None) -> DigestIndex:
        """The same digests in a new index, one sorted file a bucket; the old one stays until its folder is deleted."""
        fresh = DigestIndex(self.spark, path, self.buckets)
        fresh.append(self.rows())
        return fresh

    def close(self) -> None:
        """Takes the table out of the catalog; its files stay at ``path``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def ingest(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Dedupes ``docs`` (doc_id, text) against the index and within itself, and appends the new digests.

    Returns a row per input row: doc_id, keep_id, group_size (rows of this batch), kept, text_sha256, and
    is_new (the digest was not in the index before). Of equal texts of a batch the one with the most code points,
    then the smallest doc_id stays; a text that another batch brought is never kept again. ``batch`` names the batch: the
    same rows ingested again under their name, say after a failure, get the same answers and add nothing twice; without a
    name each call is a batch of its own.
    Null text counts as empty; a null doc_id comes after all others (its ``kept`` is true only where the group has no
    other id). Rows repeated with one doc_id get the same answer each. An empty table gives no rows. Columns besides
    doc_id and text are not looked at.
    """
    rows, groups = digested(docs, index, batch)
    facts = groups.select(
        F.col("text_sha256"),
        F.coalesce("old_id", "keep_id").alias("keep_id"),
        "group_size",
        "is_new",
    )
    total = rows.count()
    hot = facts.where(F.col("group_size") * HOT > total)
    cold = facts.where(F.col("group_size") * HOT <= total)
    common = F.broadcast(hot.select("text_sha256"))
    joined = rows.join(F.broadcast(hot), "text_sha256").unionByName(
        rows.join(common, "text_sha256", "left_anti").join(cold, "text_sha256")
    )
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("is_new")).alias("kept"),
        "text_sha256",
        "is_new",
    )


def digested(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The batch's rows (doc_id, text_sha256, points) and its digests, a row each (text_sha256, keep_id, group_size, old_id,
    is_new), of which the index has the new ones from now on."""
    batch = batch or uuid.uuid4().hex
    rows = written(
        docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256"), F.coalesce(F.length("text"), F.lit(0)).alias("points")),
        "digests",
    )
    best = F.max(F.struct("points", F.bitwise_not(F.col("doc_id")).alias("behind")))
    others = index.rows().where(F.col("batch") != batch)
    groups = written(
        rows.groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(
            "text_sha256",
            F.bitwise_not(F.col("best.behind")).alias("keep_id"),
            F.col("best.points").alias("keep_points"),
            "group_size",
        )
        .join(others.select("text_sha256", F.col("keep_id").alias("old_id")).hint("merge"), "text_sha256", "left")
        .select("text_sha256", "keep_id", "keep_points", "group_size", "old_id", F.col("old_id").isNull().alias("is_new")),
        "groups",
    )
    seen = index.rows().select("text_sha256").hint("merge")
    index.append(groups.join(seen, "text_sha256", "left_anti").withColumn("batch", F.lit(batch)))
    return rows, groups


def unique_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that :func:`ingest` keeps, one for each text, with all their columns.

    Where the row that stays is itself repeated, one of the repeats stays: one with the most code points, not null before
    null, then the last by its columns as JSON.
    """
    rows, groups = digested(docs, index)
    times = rows.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("times"))  # copies of a text part by their ids
    stays = groups.where("is_new").select(F.col("text_sha256").alias("digest"), "keep_id")
    met = (F.col("text_sha256") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = written(times.join(stays.hint("merge"), met, "left_semi"), "kept")
    found = docs.select(F.struct("*").alias("row"), text_digest(F.col("text")).alias("sha"), F.col("doc_id").alias("id")).join(
        kept, (F.col("sha") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("doc_id"))
    )
    once = found.where("times = 1").select("row.*")
    if kept.where("times > 1").isEmpty():
        return once
    rank = F.struct(F.coalesce(F.length("row.text"), F.lit(0)), F.col("row.text").isNotNull(), F.to_json("row"))
    again = found.where("times > 1").groupBy("sha").agg(F.max_by("row", rank).alias("row")).select("row.*")
    return once.unionByName(again)
