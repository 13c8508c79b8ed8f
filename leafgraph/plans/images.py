"""Plans over placements and rasters: q18 to q40, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators import gray, placement, profiles, raster
from leafgraph.plans.base import RASTER, table
from leafgraph.plans.base import raster as rasters

SQL: dict[str, str] = {}


def _size(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return 20 * (k % 50 + 1), 30 * (k % 40 + 1)


def _dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, dpi: each order as an image that its line items draw."""
    w, h = _size("l_orderkey")
    zero = F.lit(0.0)
    drawn = placement.drawn_dpi(w, h, F.col("l_quantity") * 4, zero, zero, F.col("l_linenumber") * 40.0)
    return placement.lowest_dpi(table(spark, sf_dir, "lineitem").select("l_orderkey", drawn.alias("dpi")), "l_orderkey")


DPI = """dpi AS (SELECT l_orderkey, min(least((20 * (l_orderkey % 50 + 1)) / (l_quantity * 4 * (1.0::DOUBLE / 72)), (30 * (l_orderkey % 40 + 1)) / (l_linenumber * 40.0::DOUBLE * (1.0::DOUBLE / 72)))) AS dpi
  FROM lineitem GROUP BY l_orderkey)"""


def _milli(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5).cast("long")


def q18_min_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dpi(spark, sf_dir).select("l_orderkey", _milli(F.col("dpi")).alias("dpi"))


SQL["q18_min_dpi"] = f"WITH {DPI} SELECT l_orderkey, floor(dpi * 1000 + 0.5)::BIGINT AS dpi FROM dpi"


def q19_known_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return placement.known_only(q18_min_dpi(spark, sf_dir), unknown, "l_orderkey")


SQL["q19_known_dpi"] = f"""
WITH {DPI} SELECT l_orderkey, floor(dpi * 1000 + 0.5)::BIGINT AS dpi FROM dpi
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""


def q20_smask_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("mask_width"))
    rows = uses.join(_dpi(spark, sf_dir), "l_orderkey").join(parts, "l_partkey")
    rows = rows.withColumn("width", _size("l_orderkey")[0]).withColumn("unknown", F.col("l_orderkey") % 50 == 0)
    return placement.mask_dpi(rows, "l_partkey").select("l_partkey", F.when(F.col("dpi") < 0, F.lit(-1)).otherwise(_milli(F.col("dpi"))).alias("dpi"))


SQL["q20_smask_dpi"] = f"""
WITH {DPI}, u AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem),
m AS (SELECT l_partkey, min(dpi * p_size / (20 * (l_orderkey % 50 + 1))) AS d, bool_or(l_orderkey % 50 = 0 OR p_size <= 0) AS poison
  FROM u JOIN dpi USING (l_orderkey) JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_partkey, CASE WHEN poison THEN -1 ELSE floor(d * 1000 + 0.5)::BIGINT END AS dpi FROM m"""


def q21_unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters(spark, sf_dir)
    return rows.select("vec_id", *[raster.total(raster.unpacked(F.col("q"), b)).alias(f"sum{b}") for b in (1, 2, 4)])


def _unpack_sql(bits: int) -> str:
    top = (1 << bits) - 1
    parts = " + ".join(f"(((q[i] >> {8 - bits - at}) & {top}) * 255 // {top})" for at in range(0, 8, bits))
    return f"sum({parts})::BIGINT AS sum{bits}"


SQL["q21_unpack_bits"] = f"WITH {RASTER} SELECT vec_id, {', '.join(map(_unpack_sql, (1, 2, 4)))} FROM r, range(1, 65) AS g(i) GROUP BY vec_id"


def q22_pack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform("q", lambda v: F.when(v >= 128, 1).otherwise(0))
    return rasters(spark, sf_dir).select("vec_id", F.array_join(raster.packed(bits, 8).cast("array<string>"), " ").alias("bytes"))


SQL["q22_pack_bits"] = f"""
WITH {RASTER}, b AS (SELECT vec_id, y, sum((q[y * 8 + x + 1] >= 128)::INT << (7 - x)) AS byte FROM r, range(8) AS a(y), range(8) AS c(x) GROUP BY ALL)
SELECT vec_id, string_agg(byte::VARCHAR, ' ' ORDER BY y) AS bytes FROM b GROUP BY vec_id"""


def q23_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = raster.downscaled(F.col("q"), 8, 8, 3, 3)
    return rasters(spark, sf_dir).select("vec_id", F.array_join(small.cast("array<string>"), " ").alias("q"))


SQL["q23_downscale"] = f"""
WITH {RASTER}, t AS (SELECT s, i, least((s + 1) * 3, (i + 1) * 8) - greatest(s * 3, i * 8) AS w FROM range(8) AS a(s), range(3) AS b(i)),
c AS (SELECT vec_id, v.i AS y, h.i AS x, sum(q[v.s * 8 + h.s + 1] * v.w * h.w) AS n FROM r, t v, t h WHERE v.w > 0 AND h.w > 0 GROUP BY ALL)
SELECT vec_id, string_agg(((n * 2 + 64) // 128)::BIGINT::VARCHAR, ' ' ORDER BY y, x) AS q FROM c GROUP BY vec_id"""


def q24_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters(spark, sf_dir).select("vec_id", F.transform("q", lambda v: F.floor(v / 32).cast("int")).alias("c"))
    rows = rows.withColumn("p", raster.palette(F.col("c"))).withColumn("i", raster.indexed(F.col("c")))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return rows.select("vec_id", text("p").alias("palette"), text("i").alias("indices"), (raster.expanded(F.col("i"), F.col("p")) == F.col("c")).alias("same"))


SQL["q24_palette"] = f"""
WITH {RASTER}, c AS (SELECT vec_id, i, q[i] // 32 AS c FROM r, range(1, 65) AS g(i)),
f AS (SELECT vec_id, c, min(i) AS first FROM c GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY first) - 1 AS k FROM f)
SELECT vec_id, (SELECT string_agg(c::VARCHAR, ' ' ORDER BY k) FROM p WHERE p.vec_id = c.vec_id) AS palette,
  string_agg(k::VARCHAR, ' ' ORDER BY i) AS indices, true AS same FROM c JOIN p USING (vec_id, c) GROUP BY vec_id"""


def q25_palette_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.get(F.array(F.lit(128), F.lit(64), F.lit(32), F.lit(4)), (F.col("vec_id") % 4).cast("int"))
    rows = rasters(spark, sf_dir).withColumn("step", step)
    colors = F.size(raster.palette(F.transform("q", lambda v: F.floor(v / F.col("step")))))
    return rows.select("vec_id", colors.alias("colors"), raster.bits_for(colors).alias("bits"))


SQL["q25_palette_bits"] = f"""
WITH {RASTER}, n AS (SELECT vec_id, count(DISTINCT q[i] // ([128, 64, 32, 4])[vec_id % 4 + 1])::INT AS colors FROM r, range(1, 65) AS g(i) GROUP BY 1)
SELECT vec_id, colors, CASE WHEN colors <= 2 THEN 1 WHEN colors <= 4 THEN 2 WHEN colors <= 16 THEN 4 ELSE 8 END::INT AS bits FROM n"""


def q26_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray_ = F.transform(raster.pixels(F.col("q"), 3, 21), lambda p: raster.luma(p[0], p[1], p[2]))
    return rasters(spark, sf_dir).select("vec_id", raster.total(gray_).alias("luma"))


SQL["q26_luma"] = f"""
WITH {RASTER} SELECT vec_id, sum((299 * q[i] + 587 * q[i + 1] + 114 * q[i + 2] + 500) // 1000)::BIGINT AS luma FROM r, range(1, 64, 3) AS g(i) GROUP BY 1"""


def q27_cmyk_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray_ = F.transform(raster.pixels(F.col("q"), 4, 16), lambda p: raster.cmyk_gray(p[0], p[1], p[2], p[3]))
    return rasters(spark, sf_dir).select("vec_id", raster.total(gray_).alias("gray"))


SQL["q27_cmyk_gray"] = f"""
WITH {RASTER} SELECT vec_id, sum(255 - least(255, (30 * q[i] + 59 * q[i + 1] + 11 * q[i + 2]) // 100 + q[i + 3]))::BIGINT AS gray
FROM r, range(1, 65, 4) AS g(i) GROUP BY 1"""


def q28_grayness(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = lambda i: F.get(F.array(F.lit(0), i % 3, F.lit(2), F.lit(30)), (F.col("vec_id") % 4).cast("int"))
    rows = rasters(spark, sf_dir).select("vec_id", F.transform(F.slice("q", 1, 21), lambda v, i: spread(i)).alias("spreads"))
    own = F.transform(raster.pixels(F.col("q"), 3, 21), lambda p: F.array_max(p) - F.array_min(p))
    mine = rasters(spark, sf_dir).select("vec_id", raster.grayness(own).alias("own"))
    return rows.select("vec_id", raster.grayness(F.col("spreads")).alias("grayness")).join(mine, "vec_id")


SQL["q28_grayness"] = f"""
WITH {RASTER}, x AS (SELECT vec_id, max(s) AS m, sum(s) AS t, max(o) AS om, sum(o) AS ot FROM (
  SELECT vec_id, ([0, i % 3, 2, 30])[vec_id % 4 + 1] AS s, greatest(q[3 * i + 1], q[3 * i + 2], q[3 * i + 3]) - least(q[3 * i + 1], q[3 * i + 2], q[3 * i + 3]) AS o
  FROM r, range(21) AS g(i)) GROUP BY 1)
SELECT vec_id, CASE WHEN m > 24 THEN 'Color' WHEN t = 0 THEN 'Exact' WHEN t / 21 <= 1.5 THEN 'Near' ELSE 'Color' END AS grayness,
  CASE WHEN om > 24 THEN 'Color' WHEN ot = 0 THEN 'Exact' WHEN ot / 21 <= 1.5 THEN 'Near' ELSE 'Color' END AS own FROM x"""


def _stepped(v: Column) -> Column:
    kinds = F.array(F.when(v >= 128, 255).otherwise(0), F.floor(v / 64).cast("int") * 85, F.floor(v / 16).cast("int") * 17, v)
    return F.get(kinds, (F.col("vec_id") % 4).cast("int"))


STEPPED = "([CASE WHEN q[i] >= 128 THEN 255 ELSE 0 END, q[i] // 64 * 85, q[i] // 16 * 17, q[i]])[vec_id % 4 + 1]"


def q29_bit_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters(spark, sf_dir).select("vec_id", F.transform("q", _stepped).alias("v"))
    rows = rows.withColumn("bits", raster.gray_bits(F.col("v")))
    return rows.select("vec_id", "bits", raster.total(raster.few_levels(F.col("v"), F.col("bits"))).alias("levels"))


SQL["q29_bit_depth"] = f"""
WITH {RASTER}, v AS (SELECT vec_id, {STEPPED} AS v FROM r, range(1, 65) AS g(i)),
b AS (SELECT vec_id, CASE WHEN bool_and(v IN (0, 255)) THEN 1 WHEN bool_and(v % 85 = 0) THEN 2 WHEN bool_and(v % 17 = 0) THEN 4 ELSE 8 END::INT AS bits, sum(v) AS t FROM v GROUP BY 1)
SELECT vec_id, bits, (t // CASE bits WHEN 1 THEN 255 WHEN 2 THEN 85 WHEN 4 THEN 17 ELSE 1 END)::BIGINT AS levels FROM b"""


def q30_monochrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select(
        "vec_id",
        raster.extremes(F.col("q")).alias("extremes"),
        raster.mostly_extreme(F.col("q")).alias("mono"),
        raster.monochrome(F.col("q"), F.lit(200), percent=20, least=64).alias("mono20"),
        raster.total(raster.thresholded(F.col("q"))).alias("sum"),
    )


SQL["q30_monochrome"] = f"""
WITH {RASTER}, x AS (SELECT vec_id, count(*) FILTER (q[i] <= 48 OR q[i] >= 207)::INT AS n, sum(CASE WHEN q[i] >= 128 THEN 255 ELSE 0 END)::BIGINT AS s FROM r, range(1, 65) AS g(i) GROUP BY 1)
SELECT vec_id, n AS extremes, n >= 64 * 99 // 100 AS mono, n >= 64 * 20 // 100 AS mono20, s AS sum FROM x"""


def q31_bilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("vec_id", raster.bilevel(F.transform("q", _stepped)).alias("bilevel"))


SQL["q31_bilevel"] = f"WITH {RASTER} SELECT vec_id, bool_and({STEPPED} IN (0, 255)) AS bilevel FROM r, range(1, 65) AS g(i) GROUP BY 1"

PREDICT = f"""{RASTER}, n AS (SELECT vec_id, i, q[i + 1] AS v, CASE WHEN i % 8 > 0 THEN q[i] ELSE 0 END AS a, CASE WHEN i >= 8 THEN q[i - 7] ELSE 0 END AS b,
  CASE WHEN i % 8 > 0 AND i >= 8 THEN q[i - 8] ELSE 0 END AS c FROM r, range(64) AS g(i)),
p AS (SELECT *, CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END AS pa FROM n),
f AS (SELECT vec_id, i, v AS f0, (v - a + 256) % 256 AS f1, (v - b + 256) % 256 AS f2, (v - (a + b) // 2 + 256) % 256 AS f3, (v - pa + 256) % 256 AS f4 FROM p)"""


def q32_png_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters(spark, sf_dir).select("vec_id", F.posexplode(raster.predicted(F.col("q"), 8)).alias("i", "f"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), *[F.col("f")[k].alias(f"f{k}") for k in range(5)])


SQL["q32_png_predict"] = f"WITH {PREDICT} SELECT vec_id, i, {', '.join(f'f{k}::INT AS f{k}' for k in range(5))} FROM f"


def q33_png_best_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters(spark, sf_dir).select("vec_id", F.posexplode(raster.best_filter(F.col("q"), 8, 8)).alias("row", "filter"))
    return rows.select("vec_id", F.col("row").cast("long").alias("row"), "filter")


SQL["q33_png_best_filter"] = f"""
WITH {PREDICT}, u AS (UNPIVOT f ON f0, f1, f2, f3, f4 INTO NAME k VALUE v),
c AS (SELECT vec_id, i // 8 AS row, substr(k, 2)::INT AS filter, sum(CASE WHEN v < 128 THEN v ELSE 256 - v END) AS cost FROM u GROUP BY ALL)
SELECT vec_id, row, filter FROM c QUALIFY row_number() OVER (PARTITION BY vec_id, row ORDER BY cost, filter) = 1"""


def q34_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters(spark, sf_dir).select("vec_id", F.posexplode(raster.pixels(raster.thresholded(F.col("q")), 8, 8)).alias("row", "v"))
    return rows.select("vec_id", F.col("row").cast("long").alias("row"), F.array_join(raster.run_lengths(F.col("v")).cast("array<string>"), " ").alias("runs"))


SQL["q34_run_lengths"] = f"""
WITH {RASTER}, v AS (SELECT vec_id, y AS row, x, q[y * 8 + x + 1] >= 128 AS v FROM r, range(8) AS a(y), range(8) AS b(x)),
c AS (SELECT *, coalesce(v <> lag(v) OVER (PARTITION BY vec_id, row ORDER BY x), false)::INT AS change FROM v),
g AS (SELECT *, sum(change) OVER (PARTITION BY vec_id, row ORDER BY x) AS island FROM c),
n AS (SELECT vec_id, row, island, count(*) AS n FROM g GROUP BY ALL)
SELECT vec_id, row, string_agg(n::VARCHAR, ' ' ORDER BY island) AS runs FROM n GROUP BY ALL"""


def q35_row_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters(spark, sf_dir).select("vec_id", raster.repeats(raster.thresholded(F.col("q")), 8, 8).alias("same"))
    both = rows.select("vec_id", F.posexplode(F.arrays_zip(F.col("same"), raster.toggles(F.col("same")).alias("toggle"))).alias("row", "x"))
    return both.select("vec_id", F.col("row").cast("long").alias("row"), F.col("x.same").alias("same"), F.col("x.toggle").alias("toggle"))


SQL["q35_row_repeat"] = f"""
WITH {RASTER}, b AS (SELECT vec_id, y AS row, list_transform(q[y * 8 + 1:y * 8 + 8], lambda v: v >= 128) AS v FROM r, range(8) AS a(y)),
s AS (SELECT vec_id, row, v = coalesce(lag(v) OVER (PARTITION BY vec_id ORDER BY row), [false, false, false, false, false, false, false, false]) AS same FROM b)
SELECT vec_id, row, same, same <> coalesce(lag(same) OVER (PARTITION BY vec_id ORDER BY row), false) AS toggle FROM s"""


def q36_decode_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    sum_ = lambda low, high: raster.total(F.transform("q", lambda v: raster.decoded(v, low, high)))
    usual = raster.default_decode(F.when(F.col("vec_id") % 3 == 0, None).when(F.col("vec_id") % 3 == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))), 1, 8)
    return rasters(spark, sf_dir).select("vec_id", usual.alias("usual"), sum_(1.0, 0.0).alias("inverted"), sum_(0.25, 0.75).alias("middle"))


SQL["q36_decode_normalise"] = f"""
WITH {RASTER} SELECT vec_id, vec_id % 3 <> 2 AS usual, sum(255 - q[i])::BIGINT AS inverted,
  sum(least(255, greatest(0, floor((0.25::DOUBLE + q[i] / 255.0::DOUBLE * 0.5::DOUBLE) * 255.0::DOUBLE + 0.5)::INT)))::BIGINT AS middle FROM r, range(1, 65) AS g(i) GROUP BY ALL"""


def q37_downsample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.broadcast(profiles.built_in(spark).select("name", F.col("max_resolution").alias("most")))  # five rows
    w, h = _size("l_orderkey")
    rows = _dpi(spark, sf_dir).withColumn("w", w).withColumn("h", h).join(chosen)
    new = placement.downsampled(F.col("w"), F.col("h"), F.col("dpi"), F.coalesce("most", F.lit(0)))
    return rows.withColumn("new", new).select("l_orderkey", "name", F.col("new.w").alias("nw"), F.col("new.h").alias("nh"))


SQL["q37_downsample_plan"] = f"""
WITH {DPI}, m(name, most) AS (VALUES {", ".join(f"('{p['name']}', {p['max_resolution'] or 0})" for p in profiles.BUILT_IN)}),
s AS (SELECT l_orderkey, name, most, dpi, 20 * (l_orderkey % 50 + 1) AS w, 30 * (l_orderkey % 40 + 1) AS h FROM dpi, m),
n AS (SELECT *, CASE WHEN most > 0 THEN greatest(1, floor(w * most / dpi + 0.5)::BIGINT) END AS nw, CASE WHEN most > 0 THEN greatest(1, floor(h * most / dpi + 0.5)::BIGINT) END AS nh FROM s),
p AS (SELECT *, coalesce(dpi * 10 > most * 12 AND nw < w AND nh < h, false) AS pays FROM n)
SELECT l_orderkey, name, CASE WHEN pays THEN nw END AS nw, CASE WHEN pays THEN nh END AS nh FROM p"""


def q38_ctm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.get(F.array(F.lit("q"), F.lit("2"), F.lit("3"), F.lit("Q")), ((F.col("turn") + F.col("conv_id")) % 4).cast("int"))
    return placement.folded_scales(table(spark, sf_dir, "conversations").select("conv_id", "turn", op.alias("op")), "conv_id", ["turn"], "op")


SQL["q38_ctm_fold"] = """
WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, (turn + conv_id) % 4 AS op FROM conversations),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 1::BIGINT AS scale, []::BIGINT[] AS stack, 0 AS depth FROM conversations
  UNION ALL SELECT s.conv_id, s.k + 1, CASE op WHEN 1 THEN scale * 2 WHEN 2 THEN scale * 3 WHEN 3 THEN coalesce(stack[1], scale) ELSE scale END,
    CASE op WHEN 0 THEN list_prepend(scale, stack) WHEN 3 THEN stack[2:] ELSE stack END,
    CASE WHEN op = 0 THEN greatest(depth, len(stack)::INT + 1) ELSE depth END FROM s JOIN o ON o.conv_id = s.conv_id AND o.k = s.k + 1)
SELECT conv_id, scale, depth FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1"""


def q39_gray_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    text = lambda n: F.concat(F.lit("0."), F.lpad(n.cast("string"), 2, "0"))
    content = F.concat_ws(" ", text(num("l_discount")), text(num("l_tax")), F.lit("0.5"), F.when(F.col("l_linenumber") % 2 == 0, "RG").otherwise("rg"))
    streams = table(spark, sf_dir, "lineitem").groupBy(content.alias("before")).agg(F.count(F.lit(1)).alias("n"))
    return streams.withColumn("after", gray.rewritten(F.col("before")))  # equal streams are rewritten once


SQL["q39_gray_operators"] = """
WITH x AS (SELECT floor(l_discount * 100 + 0.5)::BIGINT AS d, floor(l_tax * 100 + 0.5)::BIGINT AS t, l_linenumber % 2 = 0 AS stroke FROM lineitem),
g AS (SELECT *, floor(d * 29.9 + t * 58.7 + 570 + 0.5)::BIGINT AS raw FROM x),
n AS (SELECT d, t, stroke, 299 * d + 587 * t + 114 * 50 AS m, count(*) AS n FROM x GROUP BY ALL)
SELECT '0.' || lpad(d::VARCHAR, 2, '0') || ' 0.' || lpad(t::VARCHAR, 2, '0') || ' 0.5 ' || CASE WHEN stroke THEN 'RG' ELSE 'rg' END AS before,
  rtrim(rtrim('0.' || lpad(((m + 5) // 10)::VARCHAR, 4, '0'), '0'), '.') || CASE WHEN stroke THEN ' G' ELSE ' g' END AS after, n FROM n"""


def q40_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_orderkey") % 1500 - 200) / 1000.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", gray.number(x).alias("text")).distinct()


SQL["q40_number_format"] = """
WITH x AS (SELECT DISTINCT l_orderkey, least(1000, greatest(0, l_orderkey % 1500 - 200)) AS m FROM lineitem)
SELECT l_orderkey, CASE m WHEN 1000 THEN '1' WHEN 0 THEN '0' ELSE rtrim('0.' || lpad(m::VARCHAR, 3, '0'), '0') END AS text FROM x"""
