"""Operators on hand-made inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leafgraph.operators import dedup, graph, gray, naming, placement, profiles, progress, prune, raster, select


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ints(*values):
    return F.array(*[F.lit(v) for v in values])


def test_reachability_is_safe_in_cycles_and_keeps_the_least_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (4, 5), (3, None)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (None,)], "node long")
    assert {(r.node, r.depth) for r in graph.reachable(edges, roots).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert graph.reachable(edges, roots.limit(0)).count() == 0


def test_rewriting_leaves_unmapped_references(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "ref long, v string")
    mapping = spark.createDataFrame([(1, 9)], "old long, new long")
    assert sorted((r.ref or 0, r.v) for r in graph.rewritten(rows, "ref", mapping).collect()) == [(0, "c"), (2, "b"), (9, "a")]


def test_survivors_tell_null_from_empty_and_parts_apart(spark):
    rows = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc"), (3, None, "x"), (4, "", "x"), (5, None, "x")], "k long, a string, b string")
    found = {r.k: r.survivor for r in dedup.survivors(rows, "k", [rows.a, rows.b]).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_strip_list():
    assert prune.strip_list(" Metadata, editing ,metadata") == ["metadata", "editing"]
    assert prune.strip_list("all") == list(prune.STRIPPABLE)
    with pytest.raises(ValueError):
        prune.strip_list("everything")


def test_best_candidate_prefers_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 2, 10), (1, 1, 10), (1, 3, 11), (2, 5, 7)], "k long, ordinal int, score long")
    assert sorted((r.k, r.ordinal) for r in select.best(rows, "k").collect()) == [(1, 1), (2, 5)]


def test_refining_sees_the_shortlist_only(spark):
    rows = spark.createDataFrame([(1, 1, 100), (1, 2, 115), (1, 3, 116)], "k long, ordinal int, score long")
    assert sorted(r.ordinal for r in select.shortlist(rows, "k").collect()) == [1, 2]


def test_samples_survive_packing(spark):
    samples = [1, 0, 1, 1, 0, 0, 1, 0, 1, 1] * 2
    packed = one(spark, raster.packed(ints(*samples), 10))
    assert packed == [0b10110010, 0b11000000] * 2
    back = one(spark, raster.unpacked(ints(*packed), 1))
    assert [v // 255 for v in back[:10]] == samples[:10]
    assert one(spark, raster.unpacked(ints(0x1B), 2)) == [0, 85, 170, 255]
    assert one(spark, raster.unpacked(ints(0xAB, 0xCD), 16)) == [0xAB]


def test_predicted_samples_can_be_restored(spark):
    width, samples = 4, [3, 200, 7, 7, 90, 1, 255, 0, 13, 13, 40, 41]
    for kind in range(5):
        row = one(spark, F.transform(raster.predicted(ints(*samples), width), lambda f: f[kind]))
        back = []
        for i, v in enumerate(row):
            a = back[i - 1] if i % width else 0
            b = back[i - width] if i >= width else 0
            c = back[i - width - 1] if i % width and i >= width else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            back.append((v + [0, a, b, (a + b) // 2, nearest][kind]) % 256)
        assert back == samples


def test_grayness_and_depth(spark):
    assert one(spark, raster.grayness(F.expr("cast(array() as array<int>)"))) == "Exact"
    assert one(spark, raster.grayness(ints(0, 25))) == "Color"
    assert one(spark, raster.grayness(ints(1, 2))) == "Near"
    assert one(spark, raster.gray_bits(ints(0, 170))) == 2
    assert one(spark, raster.gray_bits(ints(0, 18))) == 8


def test_runs(spark):
    assert one(spark, raster.run_lengths(ints(0, 0, 255, 0, 0, 0))) == [2, 1, 3]
    assert one(spark, raster.run_lengths(F.expr("cast(array() as array<int>)"))) == []


def test_gray_operators(spark):
    for before, after in {
        "1 0 0 rg": "0.299 g",
        "0 0 0 1 K": "0 G",
        "1 0 rg": "1 0 rg",
        "a b c rg": "a b c rg",
        "0.5 g": "0.5 g",
        "1 1 1 RG": "1 G",
    }.items():
        assert one(spark, gray.rewritten(F.lit(before))) == after


def test_matrix_stack_ignores_what_is_not_there_to_restore(spark):
    end = one(spark, placement.folded_scale(F.array(*map(F.lit, ["Q", "2", "q", "3", "q", "5", "Q", "Q", "7"]))))
    assert (end["scale"], end["depth"]) == (14, 2)


def test_mask_is_unknown_if_any_parent_is(spark):
    uses = spark.createDataFrame([(1, 10, 20, 100.0, False), (1, 10, 40, 90.0, False), (2, 10, 20, 50.0, True), (3, 10, None, 1.0, False)], "m int, mask_width int, width int, dpi double, unknown boolean")
    assert {r.m: r.dpi for r in placement.mask_dpi(uses, "m").collect()} == {1: 22.5, 2: -1.0, 3: -1.0}


def by_weights(samples, threshold=10.0):
    """The time left by its definition: at each sample the projected end is a weighted mean of t / fraction of all samples so
    far, each as heavy as time has passed before it, at exponential decay."""
    taken = [(t, min(f, 1.0)) for f, t in samples if f > 0.01 and t >= 1]
    ends = []
    for n, (t, f) in enumerate(taken):
        weights = [1.0] + [1 - math.exp((a - b) / 2) for (a, _), (b, _) in zip(taken[:n], taken[1 : n + 1])]
        decay = [math.prod(1 - w for w in weights[k + 1 :]) for k in range(n + 1)]
        first = max([k for k in range(n + 1) if taken[k][1] == 1], default=0)  # a finished sample forgets what was before it
        if first:
            weights[first] = 1.0
        ends.append(sum(weights[k] * decay[k] * taken[k][0] / taken[k][1] for k in range(first, n + 1)))
    shown = False
    for n, (t, _) in enumerate(taken):
        back = n
        while back >= 0 and ends[back] > threshold:
            back -= 1
        shown |= back < n and t - taken[back + 1][0] >= 2
    return max(0.0, ends[-1] - taken[-1][0]) if shown else None


def test_time_left_is_that_of_weighted_projections(spark):
    rng = random.Random(8)
    runs = []
    for _ in range(60):
        times = sorted(rng.uniform(0, rng.choice([6, 40])) for _ in range(rng.randrange(1, 12)))
        shares = sorted(rng.choice([rng.random(), rng.random() ** 3, 1.0, 0.005]) for _ in times)
        runs.append(list(zip(shares, times)))
    want = [by_weights(r) for r in runs]
    assert sum(w is None for w in want) > 5 and sum(w is not None for w in want) > 20
    rows = spark.createDataFrame([(i, f, t) for i, r in enumerate(runs) for f, t in r], "run long, fraction double, t double")
    for found in (progress.times_left(rows, "run"), rows.groupBy("run").agg(progress.time_left(F.sort_array(F.collect_list(F.struct("t", "fraction")))).alias("left"))):
        got = {r.run: r.left for r in found.collect()}
        assert all(got[i] == (None if w is None else pytest.approx(w, abs=1e-9)) for i, w in enumerate(want))


def test_folds_stream_a_key_with_a_third_of_all_rows(spark):
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("t"))
    got = {r.k: r.n for r in progress.reported(rows, "k", "t", 30).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[-1] == 3000 and len(got) == 501
    ops = rows.select("k", "t", F.when(F.col("t") % 2 == 0, "q").otherwise("Q").alias("op"))
    assert {(r.scale, r.depth) for r in placement.folded_scales(ops.where("k = -1"), "k", ["t"], "op").collect()} == {(1, 1)}
    assert progress.reported(rows.limit(0), "k", "t", 30).count() == 0


def test_throttle_counts_from_the_last_report(spark):
    times = F.array(*[F.lit(t).cast("long") for t in (0, 4, 8, 12, 13, 30)])
    assert one(spark, progress.throttled(times, 10)) == [0, 12, 30]


def test_names(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "k int, base string")
    existing = spark.createDataFrame([("a",), ("a 3",), ("b 2",)], "name string")
    assert {r.k: r["name"] for r in naming.numbered(items, "base", "k", existing).collect()} == {1: "a 2", 2: "a 4", 3: "a 5", 4: "b"}
    assert one(spark, naming.natural_key(F.lit("f2")) < naming.natural_key(F.lit("F10")))
    longer = ["9", "9" * 20, "1" + "0" * 20, "1" + "0" * 19 + "1", "2" + "0" * 20, "1" * 40]
    keys = [one(spark, naming.natural_key(F.lit(f"f{n}.pdf"))) for n in longer]
    assert [k for _, k in sorted(zip(map(int, longer), keys))] == sorted(keys) and len(set(keys)) == len(keys)
    assert one(spark, naming.common_prefix(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c")))) == ["a"]


def test_profiles(spark):
    old = one(spark, profiles.parsed(F.lit('{"id": 7, "name": "Old"}')))
    assert (old["image_quality"], old["max_resolution"], old["compress_images"]) == (0.6, None, True)
    assert one(spark, profiles.parsed(F.lit("{broken"))) is None
    base = profiles.built_in(spark)
    own = base.where("id = 3").withColumn("grayscale", F.lit(True))
    assert profiles.upserted(base.limit(0), own, base).count() == 1
    assert profiles.upserted(own, base.where("id = 3"), base).count() == 0
    texts = {r["name"]: r["s"] for r in base.select("name", profiles.summary({c: F.col(c) for c in base.columns}).alias("s")).collect()}
    assert texts["High"] == "110 dpi · JPEG 40% · No metadata" and texts["Lossless"] == "Lossless"


def test_profiles_of_other_ids_are_read_once_and_go_where_they_are_read(spark, capsys):
    base = profiles.built_in(spark)
    texts = spark.range(5000).select(F.to_json(F.struct("id", F.lit("Own").alias("name"), F.lit(0.5).alias("image_quality"))).alias("text"))
    odd = spark.createDataFrame([(None,), ("{broken",), ('{"name": "no id"}',), ('{"id": 3, "name": "A first"}',), ('{"id": 3000000000, "name": "A far id"}',)], "text string")
    found = profiles.effective(base, texts.union(odd).select(profiles.parsed(F.col("text")).alias("p")).select("p.*"))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("from_json") == 2  # once for each side of the union
    assert plan.index("partial_min_by") < plan.index("LeftSemi")  # plans are printed from the last step to the first
    got = {r.id: (r["name"], r.image_quality) for r in found.collect()}
    assert got == {1: ("Own", 0.5), 2: ("Own", 0.5), 3: ("A first", 0.6), 4: ("Own", 0.5), 5: ("Own", 0.5)}
