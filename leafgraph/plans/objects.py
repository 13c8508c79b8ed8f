"""Plans over object graphs: q01 to q17, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators import dedup, graph, prune, select
from leafgraph.plans.base import CANDIDATES, candidates, cents, table

SQL: dict[str, str] = {}


def q01_reachable_from_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    node = lambda kind, key: F.struct(F.lit(kind).alias("type"), F.col(key).cast("long").alias("id"))
    edges = [
        t("nation").select(node("region", "n_regionkey").alias("src"), node("nation", "n_nationkey").alias("dst")),
        t("customer").select(node("nation", "c_nationkey").alias("src"), node("customer", "c_custkey").alias("dst")),
        t("orders").select(node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("dst")),
    ]
    roots = t("region").where("r_regionkey = 0").select(node("region", "r_regionkey").alias("node"))
    found = graph.reachable(edges[0].unionByName(edges[1]).unionByName(edges[2]), roots)
    return found.groupBy(F.col("node.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


SQL["q01_reachable_from_region"] = """
WITH RECURSIVE e AS (SELECT 'region' AS st, n_regionkey::BIGINT AS s, 'nation' AS dt, n_nationkey::BIGINT AS d FROM nation
  UNION ALL SELECT 'nation', c_nationkey, 'customer', c_custkey FROM customer
  UNION ALL SELECT 'customer', o_custkey, 'order', o_orderkey FROM orders),
w AS (SELECT 'region' AS type, r_regionkey::BIGINT AS id FROM region WHERE r_regionkey = 0
  UNION SELECT e.dt, e.d FROM w JOIN e ON e.st = w.type AND e.s = w.id)
SELECT type, count(*) AS n FROM w GROUP BY type"""


def q02_reachable_depth_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    edges = pairs.select(node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    roots = spark.createDataFrame([("s1",)], "node string")
    return graph.reachable(both, roots, max_depth=3).select("node", F.col("depth").cast("int").alias("depth"))


SQL["q02_reachable_depth_bounded"] = """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
d1 AS (SELECT DISTINCT p FROM e WHERE s = 1),
d2 AS (SELECT DISTINCT s FROM e WHERE p IN (FROM d1) AND s <> 1),
d3 AS (SELECT DISTINCT p FROM e WHERE s IN (FROM d2) AND p NOT IN (FROM d1))
SELECT 's1' AS node, 0 AS depth UNION ALL SELECT 'p' || p, 1 FROM d1 UNION ALL SELECT 's' || s, 2 FROM d2 UNION ALL SELECT 'p' || p, 3 FROM d3"""


def q03_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 45 and l_returnflag = 'R'")
    return graph.unreferenced(table(spark, sf_dir, "part"), used, "p_partkey", "l_partkey").select("p_partkey", "p_name")


SQL["q03_unreferenced"] = """
SELECT p_partkey, p_name FROM part WHERE NOT EXISTS
  (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45 AND l_returnflag = 'R')"""


def q04_dup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup.survivors(docs, "doc_id", [docs.text]).select("doc_id", F.col("survivor").alias("survivor_id"))


SQL["q04_dup_survivors"] = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS survivor_id FROM documents"


def q05_dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(dedup.survivors(docs, "doc_id", [docs.text]), "doc_id")
    stays = F.col("doc_id") == F.col("survivor")
    sums = rows.agg(
        F.count(F.lit(1)).alias("streams"),
        F.count_if(~stays).alias("duplicates_removed"),
        F.sum("bytes").alias("bytes_before"),
        F.sum(F.when(stays, F.col("bytes"))).alias("bytes_after"),
    )
    return sums.withColumn("saved_fraction", select.saved_fraction(F.col("bytes_before"), F.col("bytes_after")))


SQL["q05_dup_summary"] = """
WITH d AS (SELECT strlen(text) AS b, doc_id = min(doc_id) OVER (PARTITION BY text) AS stays FROM documents)
SELECT count(*) AS streams, count(*) FILTER (NOT stays) AS duplicates_removed, sum(b)::BIGINT AS bytes_before,
  sum(b) FILTER (stays)::BIGINT AS bytes_after, greatest(0, sum(b) - sum(b) FILTER (stays))::DOUBLE / sum(b) AS saved_fraction FROM d"""


def q06_dup_with_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup.survivors(docs, "doc_id", [docs.lang, docs.source, docs.text]).select("doc_id", F.col("survivor").alias("survivor_id"))


SQL["q06_dup_with_dict"] = "SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, source, text) AS survivor_id FROM documents"


def q07_rewrite_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mapping = dedup.replacements(dedup.survivors(docs, "doc_id", [docs.text]), "doc_id")
    rows = graph.rewritten(table(spark, sf_dir, "labels"), "doc_id", mapping)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("refs"), F.sum(F.col("quality").cast("long")).alias("quality"))


SQL["q07_rewrite_refs"] = """
WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS new FROM documents)
SELECT coalesce(m.new, l.doc_id) AS doc_id, count(*) AS refs, sum(quality)::BIGINT AS quality
FROM labels l LEFT JOIN m USING (doc_id) GROUP BY 1"""

#: Strip lists of q08, one for each event by event_id % 7.
LISTS = ["metadata", "bookmarks", " Annotations", "attachments,metadata", "javascript", "editing , Bookmarks", "ALL"]


def q08_strip_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.array(*[F.array(*map(F.lit, prune.strip_list(x))) for x in LISTS])
    rows = table(spark, sf_dir, "events").withColumn("stripped", F.get(lists, (F.col("event_id") % 7).cast("int")))
    entries = F.create_map(F.lit("Root"), F.lit("1"), F.lit("Info"), F.col("props"), F.lit("Size"), F.lit("2"), F.lit("ID"), F.col("event_type"))
    return rows.select(
        "event_id",
        prune.kept_unless(F.col("props"), F.col("stripped"), "metadata").alias("props"),
        F.array_join(F.array_sort(F.map_keys(prune.trailer(entries, F.col("stripped")))), ",").alias("trailer"),
    )


SQL["q08_strip_options"] = """
SELECT event_id, CASE WHEN event_id % 7 IN (0, 3, 6) THEN NULL ELSE props END AS props,
  CASE WHEN event_id % 7 IN (0, 3, 6) THEN 'ID,Root' ELSE 'ID,Info,Root' END AS trailer FROM events"""


def q09_strip_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(html).cast("long").alias("before"), F.length(prune.without_scripts(html)).cast("long").alias("after"))


SQL["q09_strip_script"] = r"""
SELECT page_id, length(html) AS before, length(regexp_replace(html, '<script>.*?</script>', '', 'gs')) AS after FROM pages"""


def q10_strip_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", prune.without(F.array(F.struct("turn", "role")), "role", "system").alias("left"))
    return turns.groupBy("conv_id").agg(F.sum(F.size("left").cast("long")).alias("turns"))


SQL["q10_strip_annotations"] = "SELECT conv_id, count(*) FILTER (role IS DISTINCT FROM 'system') AS turns FROM conversations GROUP BY conv_id"


def q11_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("l_orderkey", "ordinal", "score")


SQL["q11_candidate_scores"] = f"WITH {CANDIDATES} SELECT l_orderkey, ordinal, score FROM cand"


def q12_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best(candidates(spark, sf_dir), "l_orderkey").select("l_orderkey", "ordinal", "size", "score")


SQL["q12_best_candidate"] = f"""
WITH {CANDIDATES} SELECT l_orderkey, ordinal, size, score FROM cand
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score, ordinal) = 1"""


def q13_accept_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = candidates(spark, sf_dir).groupBy("l_orderkey").agg(F.min("size").alias("new"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("old"))
    rows = least.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    new = select.accepted(F.col("new"), F.col("old"))
    return rows.agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(new).alias("replaced"),
        F.sum("old").alias("bytes_before"),
        F.sum(F.when(new, F.col("new")).otherwise(F.col("old"))).alias("bytes_after"),
    )


SQL["q13_accept_guard"] = f"""
WITH {CANDIDATES}, x AS (SELECT n, floor(o_totalprice / 1000)::BIGINT AS o FROM (SELECT l_orderkey, min(size) AS n FROM cand GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS images, count(*) FILTER (n + 16 < o) AS replaced, sum(o)::BIGINT AS bytes_before,
  sum(CASE WHEN n + 16 < o THEN n ELSE o END)::BIGINT AS bytes_after FROM x"""


def q14_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.shortlist(candidates(spark, sf_dir), "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("lowest").alias("lowest"))


SQL["q14_shortlist"] = f"""
WITH {CANDIDATES} SELECT l_orderkey, count(*) AS n, min(least) AS lowest FROM
(SELECT *, min(score) OVER (PARTITION BY l_orderkey) AS least FROM cand) WHERE score * 100 <= least * 115 GROUP BY 1"""


def q15_change_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select.best(candidates(spark, sf_dir), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("old"))
    rows = best.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    new = select.accepted(F.col("size"), F.col("old"))
    return rows.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(new).alias("changed"),
        F.count_if(new & F.col("lossy")).alias("downsampled"),
        F.sum(F.when(new, F.col("old")).otherwise(F.lit(0))).alias("bytes_before"),
        F.sum(F.when(new, F.col("size")).otherwise(F.lit(0))).alias("bytes_after"),
    )


SQL["q15_change_counters"] = f"""
WITH {CANDIDATES}, b AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score, ordinal) = 1),
x AS (SELECT *, floor(o_totalprice / 1000)::BIGINT AS o, size + 16 < floor(o_totalprice / 1000)::BIGINT AS new FROM b JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderstatus, count(*) AS images, count(*) FILTER (new) AS changed, count(*) FILTER (new AND lossy) AS downsampled,
  coalesce(sum(o) FILTER (new), 0)::BIGINT AS bytes_before, coalesce(sum(size) FILTER (new), 0)::BIGINT AS bytes_after FROM x GROUP BY 1"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a file: its price before, and after; one in five grows."""
    before = cents(F.col("o_totalprice"))
    after = F.when(F.col("o_orderkey") % 5 == 0, before + F.col("o_orderkey") % 1000).otherwise(F.expr("before - before div (2 + o_orderkey % 7)"))
    return table(spark, sf_dir, "orders").withColumn("before", before).withColumn("after", after)


ORDERS = """f AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN before + o_orderkey % 1000 ELSE before - before // (2 + o_orderkey % 7) END AS after
  FROM (SELECT *, floor(o_totalprice * 100 + 0.5)::BIGINT AS before FROM orders))"""


def q16_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _orders(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("before").alias("before"),
        F.sum("after").alias("after"),
        F.sum(select.saved(F.col("before"), F.col("after"))).alias("saved"),
    )
    percent = F.when((F.col("files") > 1) & (F.col("before") > 0), F.floor((F.col("before") - F.col("after")) * 100.0 / F.col("before") + 0.5).cast("long"))
    return sums.withColumn("percent", percent)


SQL["q16_batch_totals"] = f"""
WITH {ORDERS} SELECT count(*) AS files, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, sum(greatest(0, before - after))::BIGINT AS saved,
  floor((sum(before) - sum(after)) * 100.0::DOUBLE / sum(before) + 0.5)::BIGINT AS percent FROM f"""


def q17_saved_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    args = (F.col("before"), F.col("after"))
    return sums.select("o_custkey", select.saved(*args).alias("saved"), select.saved_fraction(*args).alias("fraction"))


SQL["q17_saved_fraction"] = f"""
WITH {ORDERS}, s AS (SELECT o_custkey, sum(before)::BIGINT AS b, sum(after)::BIGINT AS a FROM f GROUP BY 1)
SELECT o_custkey, greatest(0, b - a)::BIGINT AS saved, CASE WHEN b > 0 THEN greatest(0, b - a)::DOUBLE / b ELSE 0.0 END AS fraction FROM s"""
