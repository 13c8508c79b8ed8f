"""Plans over runs, histories, names and profiles: q41 to q55, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgraph.operators import dedup, folds, naming, profiles, progress
from leafgraph.plans.base import cents, table

SQL: dict[str, str] = {}


def q41_running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("f", F.col("value") / 500)
    return rows.select("event_id", "user_id", F.floor(progress.running(F.col("f"), ["user_id"], ["ts", "event_id"]) * 1e6 + 0.5).alias("progress"))


SQL["q41_running_progress"] = """
SELECT event_id, user_id, floor(max(least(value / 500, 1.0::DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 1e6::DOUBLE + 0.5)::BIGINT AS progress FROM events"""


def q42_weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "compressing").otherwise("waiting")
    done = progress.weighted(cents(F.col("o_totalprice")), state, F.lit(0.5))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.floor(done * 1e6 + 0.5).alias("progress"))


SQL["q42_weighted_progress"] = """
WITH w AS (SELECT o_custkey, o_orderstatus AS s, greatest(floor(o_totalprice * 100 + 0.5)::BIGINT, 1) AS w FROM orders)
SELECT o_custkey, floor(sum(CASE s WHEN 'F' THEN w WHEN 'P' THEN w * 0.5::DOUBLE ELSE 0 END)::DOUBLE / sum(w) * 1e6::DOUBLE + 0.5)::BIGINT AS progress FROM w GROUP BY 1"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t, fraction: a user's events as progress samples, a day as a second."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double").alias("s"))
    facts = rows.groupBy("user_id").agg(F.min("s").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = rows.join(facts, "user_id").select("user_id", "s", "event_id", "first", "n")
    return folds.folded(
        placed, "user_id", ["s", "event_id"], 0, lambda k, x: k + 1, "user_id long, t double, fraction double", each=lambda _, k, x: ((x[0] - x[2]) / 86400.0, k / x[3] * 0.9)
    )


def q43_time_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = progress.times_left(_samples(spark, sf_dir), "user_id")
    return found.select("user_id", F.floor(F.col("left") * 1000 + 0.5).alias("left"))


SQL["q43_time_estimate"] = """
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER w AS k, (epoch_us(ts) / 1000000::DOUBLE - min(epoch_us(ts) / 1000000::DOUBLE) OVER (PARTITION BY user_id)) / 86400.0::DOUBLE AS t,
    row_number() OVER w / (count(*) OVER (PARTITION BY user_id))::DOUBLE * 0.9::DOUBLE AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::DOUBLE AS smoothed, NULL::DOUBLE AS updated, NULL::DOUBLE AS long, NULL::DOUBLE AS remaining FROM events
  UNION ALL SELECT user_id, k, CASE WHEN go THEN est ELSE smoothed END, CASE WHEN go THEN t ELSE updated END,
    CASE WHEN NOT go THEN long WHEN t + est > 10 THEN coalesce(long, t) END,
    CASE WHEN NOT go THEN remaining WHEN remaining IS NOT NULL OR (t + est > 10 AND t - coalesce(long, t) >= 2) THEN greatest(0, est) END
  FROM (SELECT s.user_id, e.k, s.smoothed, s.updated, s.long, s.remaining, e.t, e.f > 0.01 AND e.t >= 1 AS go,
      CASE WHEN s.smoothed IS NOT NULL THEN (s.smoothed - greatest(0, e.t - s.updated)) + (e.t * (1 - e.f) / e.f - (s.smoothed - greatest(0, e.t - s.updated))) * (1 - exp(-greatest(0, e.t - s.updated) / 2))
        ELSE e.t * (1 - e.f) / e.f END AS est
    FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT user_id, floor(remaining * 1000 + 0.5)::BIGINT AS left FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""

SIX_HOURS = 6 * 3600 * 1_000_000


def q44_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return progress.reported(table(spark, sf_dir, "events").select("user_id", micros.alias("reported")), "user_id", "reported", SIX_HOURS)


SQL["q44_throttle"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events),
n AS (SELECT user_id, t, min(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {SIX_HOURS} FOLLOWING AND UNBOUNDED FOLLOWING) AS due FROM e),
s AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT n.user_id, n.due FROM s JOIN n USING (user_id, t) WHERE n.due IS NOT NULL)
SELECT user_id, t AS reported FROM s"""


def q45_history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    top = progress.latest(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return top.select("o_orderkey", "o_custkey")


SQL["q45_history_top"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000"


def q46_exclude_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    outputs = dedup.replacements(dedup.survivors(docs, "doc_id", [docs.text]), "doc_id").select(F.col("old").alias("doc_id")).where("doc_id >= 10")
    return docs.select("doc_id", "source").join(outputs, "doc_id", "left_anti")


SQL["q46_exclude_outputs"] = """
SELECT doc_id, source FROM documents QUALIFY doc_id < 10 OR doc_id = min(doc_id) OVER (PARTITION BY text)"""


def q47_status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.get(F.array(*map(F.lit, naming.STATES)), (k % 6).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))
    path = F.concat(F.when(k % 4 == 0, "/home/.Trash/").otherwise("/home/"), k.cast("string"))
    trashed = F.when(k % 3 == 0, F.concat(F.lit("/trash/"), k.cast("string")))
    return rows.select(
        "o_orderkey",
        naming.state_text(F.col("state")).alias("text"),
        naming.eligible(rows, "state").alias("eligible"),
        naming.reset(F.col("state")).alias("then"),
        naming.location(path, k % 5 != 0).alias("place"),
        naming.original_location(k % 2 == 0, trashed, path).alias("original"),
    )


SQL["q47_status_rules"] = """
WITH s AS (SELECT o_orderkey AS k, (['ready', 'locked', 'waiting', 'compressing', 'done', 'failed'])[o_orderkey % 6 + 1] AS s,
  CASE WHEN o_orderkey % 4 = 0 THEN '/home/.Trash/' ELSE '/home/' END || o_orderkey AS path FROM orders)
SELECT k AS o_orderkey, CASE s WHEN 'locked' THEN 'Password needed' ELSE upper(s[1]) || s[2:] END AS text,
  CASE WHEN (SELECT bool_or(s IN ('ready', 'failed')) FROM s) THEN s IN ('ready', 'failed') ELSE s = 'done' END AS eligible,
  CASE WHEN s IN ('waiting', 'compressing') THEN 'ready' ELSE s END AS then,
  CASE WHEN k % 5 = 0 THEN 'missing' WHEN k % 4 = 0 THEN 'trash' ELSE 'present' END AS place,
  CASE WHEN k % 6 = 0 THEN '/trash/' || k ELSE path END AS original FROM s"""


def q48_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = lambda every, n: part.where(F.col("p_partkey") % every == 0).select(F.concat("p_name", F.lit(n)).alias("name"))
    existing = old(97, "").unionByName(old(101, " 2")).unionByName(old(103, " 5")).distinct()
    return naming.numbered(part.select("p_partkey", "p_name"), "p_name", "p_partkey", existing).select("p_partkey", "name")


SQL["q48_unique_names"] = """
WITH x AS (SELECT DISTINCT p_name AS b, n FROM part, (VALUES (97, 1), (101, 2), (103, 5)) AS v(every, n) WHERE p_partkey % every = 0),
i AS (SELECT p_partkey, p_name AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part),
f AS (SELECT b, n, row_number() OVER (PARTITION BY b ORDER BY n) AS k FROM (SELECT b, unnest(range(1, count(*) + 7)) AS n FROM i GROUP BY b) s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.b = s.b AND x.n = s.n))
SELECT p_partkey, CASE WHEN n = 1 THEN b ELSE b || ' ' || n END AS name FROM i JOIN f USING (b, k)"""


def q49_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    parts = F.split(F.regexp_extract(url, r"^[^:]*://[^/]*/?([^?#]*)", 1), "/")
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract(url, r"^[^:]*://([^/]*)", 1).alias("host"), parts.alias("parts"))
    ends = rows.groupBy("host").agg(F.min("parts").alias("low"), F.max("parts").alias("high"), F.count(F.lit(1)).alias("pages"))
    return ends.select("host", "pages", F.array_join(naming.common_prefix(F.col("low"), F.col("high")), "/").alias("prefix"))


SQL["q49_common_prefix"] = """
WITH p AS (SELECT regexp_extract(url, '^[^:]*://([^/]*)', 1) AS host, string_split(regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1), '/') AS parts FROM pages),
e AS (SELECT host, count(*) AS pages, min(parts) AS low, max(parts) AS high FROM p GROUP BY 1),
n AS (SELECT *, (SELECT count(*) FROM range(1, 50) AS g(k) WHERE k <= least(len(low), len(high)) AND low[1:k] = high[1:k]) AS n FROM e)
SELECT host, pages, array_to_string(low[1:n], '/') AS prefix FROM n"""


def q50_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    stored = F.to_json(F.struct(
        F.col("event_id").cast("int").alias("id"),
        F.concat(F.lit("Own "), k.cast("string")).alias("name"),
        F.when(k % 2 == 0, k / 100.0).alias("image_quality"),
        F.when(k % 3 == 0, F.lit(True)).alias("grayscale"),
        F.when(k % 5 == 0, k + 50).alias("max_resolution"),
    ))
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    rows = events.select(profiles.parsed(stored).alias("p")).select("p.*")
    found = profiles.effective(profiles.built_in(spark), rows)
    return found.select("id", "name", profiles.percent(F.col("image_quality")).alias("quality"), profiles.summary({c: F.col(c) for c in found.columns}).alias("summary"))


SQL["q50_profiles"] = """
WITH b(id, name, compress, q, r, meta) AS (VALUES (1, 'Lossless', false, 1.0, NULL, false), (2, 'Low', true, 0.8, 300, false), (3, 'Medium', true, 0.6, 150, false),
  (4, 'High', true, 0.4, 110, true), (5, 'Maximum', true, 0.2, 72, true)),
o AS (SELECT event_id AS id, (props->>'$.k')::INT AS k FROM events),
e AS (SELECT b.id, CASE WHEN k IS NULL THEN name ELSE 'Own ' || k END AS name, k IS NOT NULL OR compress AS compress,
  CASE WHEN k IS NULL THEN q WHEN k % 2 = 0 THEN k / 100.0 ELSE 0.6 END::DOUBLE AS q, CASE WHEN k IS NULL THEN r WHEN k % 5 = 0 THEN k + 50 END AS r,
  k IS NOT NULL AND k % 3 = 0 AS gray, k IS NULL AND meta AS meta FROM b LEFT JOIN o USING (id))
SELECT id, name, least(100, greatest(1, floor(least(1, greatest(0, q)) * 100 + 0.5)::INT)) AS quality,
  concat_ws(' · ', CASE WHEN compress THEN coalesce(r || ' dpi', 'Original resolution') ELSE 'Lossless' END,
    CASE WHEN compress THEN 'JPEG ' || floor(q * 100 + 0.5)::INT || '%' END, CASE WHEN gray THEN 'Grayscale' END, CASE WHEN meta THEN 'No metadata' END) AS summary FROM e"""


def q51_nearest_detent(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenths = F.floor(F.col("l_discount") * 100 + 0.5)
    at = profiles.nearest(tenths / 10, 5)
    rows = table(spark, sf_dir, "lineitem").select(tenths.alias("tenths"), at.alias("detent"))
    return rows.groupBy("tenths", "detent").agg(F.count(F.lit(1)).alias("n")).withColumn("next", profiles.stepped(F.col("detent"), 1, 5)).withColumn("angle", profiles.dial_angle(F.col("detent") / 4))


SQL["q51_nearest_detent"] = """
WITH t AS (SELECT floor(l_discount * 100 + 0.5)::BIGINT AS tenths, count(*) AS n FROM lineitem GROUP BY 1),
d AS (SELECT tenths, n, i AS detent FROM t, range(5) AS g(i) QUALIFY row_number() OVER (PARTITION BY tenths ORDER BY abs(tenths * 4 - i * 10), i) = 1)
SELECT tenths, detent::INT AS detent, n, least(4, detent + 1)::INT AS next, 135 + 270 * (detent / 4.0::DOUBLE) AS angle FROM d"""

SIZES = [72, 96, 110, 150, 200, 300, 600]


def q52_option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(profiles.options(SIZES, F.col("p_size")).cast("array<string>"), ",").alias("options"))


SQL["q52_option_list"] = f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append({SIZES}::INT[], p_size))), ',') AS options FROM part"


def q53_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        "l_quantity",
        "n",
        progress.seconds_text(q * 3).alias("seconds"),
        profiles.percent((q - 5) / 40).alias("quality"),
        progress.twentieths(q / 50).alias("twentieths"),
        F.format_string("%d%%", F.floor(q / 50 * 100 + 0.5)).alias("percent"),
        progress.bytes_text(F.floor(q * q * q).cast("long")).alias("bytes"),
    )


SQL["q53_rounding"] = """
SELECT l_quantity, count(*) AS n, CASE WHEN l_quantity * 3 < 60 THEN greatest(5, ceil(l_quantity * 3 / 5) * 5) ELSE floor(l_quantity * 3 / 60 + 0.5) * 60 END::BIGINT AS seconds,
  least(100, greatest(1, floor(least(1, greatest(0, (l_quantity - 5) / 40)) * 100 + 0.5)::INT)) AS quality, floor(l_quantity / 50 * 20 + 0.5) / 20 AS twentieths,
  floor(l_quantity / 50 * 100 + 0.5)::INT || '%' AS percent,
  CASE WHEN l_quantity ** 3 < 1000 THEN floor(l_quantity ** 3)::BIGINT || ' bytes' ELSE floor(floor(l_quantity ** 3) / 1000 + 0.5)::BIGINT || ' KB' END AS bytes FROM lineitem GROUP BY l_quantity"""


def q54_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    given = pages.where("page_id < 10").select("url", F.lit(0).alias("arg")).unionByName(pages.select("url", F.lit(1).alias("arg")))
    once = naming.first_seen(given, "url", ["arg"])
    folder = F.regexp_extract("url", "^(.*?://[^/]*)", 1)
    keyed = once.select("url", "arg", folder.alias("folder"), naming.natural_key(F.col("url")).alias("key"))
    return keyed.withColumn("rank", F.row_number().over(W.partitionBy("arg", "folder").orderBy("key", "url")))


SQL["q54_discover"] = """
WITH g AS (SELECT url, min(CASE WHEN page_id < 10 THEN 0 ELSE 1 END)::INT AS arg FROM pages GROUP BY url),
k AS (SELECT *, regexp_extract(url, '^(.*?://[^/]*)', 1) AS folder,
  array_to_string(list_transform(regexp_extract_all(lower(url), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 20, '0') ELSE r END), '') AS key FROM g)
SELECT *, row_number() OVER (PARTITION BY arg, folder ORDER BY key, url)::INT AS rank FROM k"""


def q55_cost_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    size = lambda c: F.octet_length(c).cast("long")
    kinds = [
        t("documents").select(F.lit("stream").alias("kind"), size("text").alias("bytes"), progress.stream_cost(size("text"), F.col("doc_id") % 2 == 0).alias("cost")),
        t("pages").select(F.lit("content").alias("kind"), size("html").alias("bytes"), progress.content_cost(size("html"), F.col("page_id") % 3 == 0).alias("cost")),
        t("embeddings").select(
            F.lit("image").alias("kind"),
            F.lit(64).cast("long").alias("bytes"),
            progress.image_cost(F.lit(8), F.lit(8), F.lit(1), (F.col("vec_id") % 20).cast("int"), F.col("vec_id") % 5 == 0).alias("cost"),
        ),
    ]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("level", progress.deflate_level(F.col("bytes")))
    return rows.groupBy("kind", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), progress.write_cost(F.count(F.lit(1)), F.sum("bytes")).alias("write")
    )


SQL["q55_cost_plan"] = """
WITH o AS (SELECT 'stream' AS kind, strlen(text)::BIGINT AS b, strlen(text) * CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 1 END * 330 AS c FROM documents
  UNION ALL SELECT 'content', strlen(html), strlen(html) * CASE WHEN page_id % 3 = 0 THEN 4 ELSE 1 END * 25 FROM pages
  UNION ALL SELECT 'image', 64, (64 * least(16, greatest(1, vec_id % 20)) // 8) * CASE WHEN vec_id % 5 = 0 THEN 50 ELSE 200 END FROM embeddings)
SELECT kind, CASE WHEN b <= 16 * 1048576 THEN 12 WHEN b <= 64 * 1048576 THEN 9 ELSE 6 END::INT AS level, count(*) AS n, sum(c)::BIGINT AS cost, (count(*) * 1000 + sum(b) * 2)::BIGINT AS write FROM o GROUP BY ALL"""
