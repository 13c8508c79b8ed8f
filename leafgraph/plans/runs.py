"""Plans q60 to q70: options of runs, files' states, entries of objects and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators import compress, options, pages, profiles
from leafgraph.plans.base import RASTER, raster, table

SQL: dict[str, str] = {}


def count() -> Column:
    return F.count(F.lit(1)).alias("n")


def q60_profile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 3, 20).alias("asked"))
    return options.by_name(asked, "asked", profiles.built_in(spark)).groupBy("asked", "profile_id").agg(count())


SQL["q60_profile_names"] = """
SELECT substr(o_orderpriority, 3, 20) AS asked, CASE lower(substr(o_orderpriority, 3, 20)) WHEN 'lossless' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3
  WHEN 'high' THEN 4 WHEN 'maximum' THEN 5 END::INT AS profile_id, count(*) AS n FROM orders GROUP BY 1, 2"""


def q61_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int") * 3)
    resolution = F.when(F.col("l_linenumber") % 3 == 0, (F.col("l_partkey") % 4 * 50).cast("int"))
    made = options.overridden(F.lit(0.6), F.lit(150), F.col("l_linestatus") == "O", quality, resolution)
    return table(spark, sf_dir, "lineitem").select(made.alias("p")).groupBy("p.compress", "p.quality", "p.resolution").agg(count())


SQL["q61_overrides"] = """
WITH o AS (SELECT l_linestatus = 'O' AS c, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT * 3 END AS q, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 4 * 50 END AS r FROM lineitem),
g AS (SELECT *, NOT coalesce(q > 100, false) AND NOT coalesce(r = 0, false) AS good FROM o)
SELECT CASE WHEN good THEN c OR q IS NOT NULL OR r IS NOT NULL END AS compress, CASE WHEN good THEN coalesce(q / 100, 0.6::DOUBLE) END AS quality,
  CASE WHEN good THEN coalesce(r, 150) END::INT AS resolution, count(*) AS n FROM g GROUP BY 1, 2, 3"""


def q62_profile_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") % 5 + 1).cast("int").alias("id"), (F.col("n_nationkey") + 100).cast("int").alias("fresh"), F.when(F.col("n_regionkey") == 0, F.col("n_name")).alias("wanted")
    )
    met = options.duplicate(asked.join(F.broadcast(profiles.built_in(spark)), "id"), F.col("fresh"), F.col("wanted"))
    return met.select("id", "name", "is_built_in", "image_quality", "max_resolution")


SQL["q62_profile_copies"] = """
WITH b(id, name, q, r) AS (VALUES (1, 'Lossless', 1.0, NULL), (2, 'Low', 0.8, 300), (3, 'Medium', 0.6, 150), (4, 'High', 0.4, 110), (5, 'Maximum', 0.2, 72))
SELECT (n_nationkey + 100)::INT AS id, CASE WHEN n_regionkey = 0 THEN n_name ELSE name || ' Copy' END AS name, false AS is_built_in, q::DOUBLE AS image_quality, r::INT AS max_resolution
FROM nation JOIN b ON b.id = n_nationkey % 5 + 1"""


def q63_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    kind = F.when(status == "F", "replace").when(status == "O", "folder").otherwise("sameFolder")
    folder = F.when(key % 3 == 0, F.concat(F.lit("/out/"), F.col("o_orderpriority")))
    suffix = F.when(key % 2 == 0, "").otherwise("-small")
    rows = table(spark, sf_dir, "orders").select(options.location(kind, folder).alias("place"), options.destination_text(kind, folder, suffix).alias("summary"))
    return rows.groupBy("place", "summary").agg(count())


SQL["q63_destinations"] = """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'replace' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'folder' ELSE 'sameFolder' END AS place,
  CASE WHEN o_orderstatus = 'F' THEN 'Originals are replaced (moved to the Trash)' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'Saved to ' || o_orderpriority
    WHEN o_orderstatus = 'O' THEN 'No output folder chosen' ELSE 'Saved next to originals as “name' || CASE WHEN o_orderkey % 2 = 0 THEN '-compressed' ELSE '-small' END || '.pdf”' END AS summary,
  count(*) AS n FROM orders GROUP BY 1, 2"""


def q64_files_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, key = F.col("url"), F.col("page_id")
    made = F.when(key % 3 != 0, F.concat(url, F.lit("-compressed")))
    return table(spark, sf_dir, "pages").select("page_id", options.shown(url, made, F.when(key % 4 != 0, key % 4 == 1)).alias("shown"))


SQL["q64_files_shown"] = "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 4 <> 1 THEN url || '-compressed' ELSE url END AS shown FROM pages"


def q65_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(options.error(F.col("user_id") % 8).alias("error")).groupBy("error").agg(count())


SQL["q65_error_codes"] = """
SELECT CASE user_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'cannotOpen' WHEN 2 THEN 'passwordRequired' WHEN 3 THEN 'wrongPassword' WHEN 4 THEN 'writeFailed' WHEN 6 THEN 'cancelled' ELSE 'failed' END AS error,
  count(*) AS n FROM events GROUP BY 1"""


def q66_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.col("o_orderstatus") != "P").alias("again"))
    return runs.select("o_custkey", options.title(F.col("files"), F.col("again")).alias("title"))


SQL["q66_titles"] = """
SELECT o_custkey, 'Compress ' || CASE WHEN count(*) = 1 THEN '1 File' ELSE count(*) || ' Files' END || CASE WHEN bool_and(o_orderstatus <> 'P') THEN ' Again' ELSE '' END AS title
FROM orders GROUP BY o_custkey"""


def q67_index_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("vec_id") % 7 == 0, F.col("vec_id") % 40)
    largest = F.array_max("q") % F.when(F.col("vec_id") % 2 == 0, 20).otherwise(256)
    bits = F.when(F.col("vec_id") % 3 == 0, 16).otherwise(8)
    rows = raster(spark, sf_dir).select(options.index_bits(largest, key).alias("bits"), options.may_reduce(bits, F.col("vec_id") % 5 == 0, key.isNotNull()).alias("may"))
    return rows.groupBy("bits", "may").agg(count())


SQL["q67_index_bits"] = f"""
WITH {RASTER},
c AS (SELECT vec_id, greatest(list_max(q) % CASE WHEN vec_id % 2 = 0 THEN 20 ELSE 256 END, CASE WHEN vec_id % 7 = 0 THEN vec_id % 40 ELSE 0 END) + 1 AS c FROM r)
SELECT CASE WHEN c <= 2 THEN 1 WHEN c <= 4 THEN 2 WHEN c <= 16 THEN 4 ELSE 8 END::INT AS bits, vec_id % 3 <> 0 OR (vec_id % 5 = 0 AND vec_id % 7 <> 0) AS may, count(*) AS n FROM c GROUP BY 1, 2"""


def q68_cut_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t"))
    body = F.to_json(F.struct("event_id", inner.alias("Names"), F.array("event_type", F.lit("end")).alias("Annots"), F.lit("m").alias("Metadata")))
    turn = F.col("event_id") % 4
    paths = F.filter(F.array(F.when(turn == 0, "/Metadata"), F.when(turn == 1, "/Names/u"), F.when(turn == 2, "/Annots/0"), F.when(turn == 3, "/Names")), lambda p: p.isNotNull())
    rows = table(spark, sf_dir, "events").select("event_id", compress.without_paths(body, paths).alias("body"))
    at = lambda path: F.get_json_object("body", path)
    return rows.select("event_id", at("$.Metadata").alias("metadata"), at("$.Names.u").alias("u"), at("$.Names.t").alias("t"), at("$.Annots[0]").alias("first"), at("$.Annots[1]").alias("second"))


SQL["q68_cut_entries"] = """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'm' END AS metadata, CASE WHEN event_id % 4 NOT IN (1, 3) THEN user_id::VARCHAR END AS u, CASE WHEN event_id % 4 <> 3 THEN event_type END AS t,
  CASE WHEN event_id % 4 = 2 THEN 'end' ELSE event_type END AS "first", CASE WHEN event_id % 4 <> 2 THEN 'end' END AS "second" FROM events"""


def q69_recompressible(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    kinds = F.when(key % 7 == 0, "/XRef").when(key % 7 == 1, "/ObjStm").when(key % 7 == 2, "/Metadata").when(key % 7 == 3, "/XObject")
    body = F.to_json(F.struct(kinds.alias("Type"), F.when(key % 2 == 0, "/Image").when(key % 3 == 0, "/Form").alias("Subtype")))
    objects = table(spark, sf_dir, "documents").select(F.when(key % 5 == 0, "dictionary").otherwise("stream").alias("kind"), body.alias("body"), F.octet_length("text").cast("long").alias("bytes"))
    return objects.where(compress.recompressible(objects)).groupBy(pages.entry("Type").alias("type")).agg(count(), F.sum("bytes").alias("bytes"))


SQL["q69_recompressible"] = """
SELECT CASE WHEN doc_id % 7 = 3 THEN '/XObject' END AS type, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents
WHERE doc_id % 5 <> 0 AND doc_id % 2 <> 0 AND doc_id % 7 > 2 GROUP BY 1"""


def q70_named_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = customers.select("c_custkey", F.col("c_nationkey").cast("string").alias("file_id"))
    own = orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") * 2).cast("int").alias("dst"), F.concat(F.lit("/Resources/XObject/O"), F.col("o_orderkey").cast("string")).alias("path"))
    refs = own.groupBy("c_custkey").agg(F.collect_list(F.struct("path", "dst")).alias("refs"))
    found = nation.join(refs, "c_custkey").select("file_id", (F.col("c_custkey") * 2 + 1).cast("int").alias("obj"), F.lit('{"Resources": {}}').alias("body"), "refs")
    price = orders.select((F.col("o_orderkey") * 2).cast("int").alias("dst"), F.floor("o_totalprice").alias("width"))
    return pages.resources(found, "XObject").join(price, "dst").select("file_id", "owner", "name", "width")


SQL["q70_named_images"] = """
SELECT c_nationkey::VARCHAR AS file_id, (c_custkey * 2 + 1)::INT AS owner, 'O' || o_orderkey AS name, floor(o_totalprice)::BIGINT AS width FROM orders JOIN customer ON o_custkey = c_custkey"""
