"""How large images are drawn: matrices, placements, resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.operators import folds

POINTS = 72
#: Inches below which a placement draws nothing.
NOTHING = 1e-4
#: Resampling pays from this many times the wanted resolution on, in tenths.
WORTH = 12


def product(m: dict[str, Column], n: dict[str, Column]) -> dict[str, Column]:
    """The matrix that applies m, then n; rows (a b 0), (c d 0), (e f 1)."""
    return {
        "a": m["a"] * n["a"] + m["b"] * n["c"],
        "b": m["a"] * n["b"] + m["b"] * n["d"],
        "c": m["c"] * n["a"] + m["d"] * n["c"],
        "d": m["c"] * n["b"] + m["d"] * n["d"],
        "e": m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        "f": m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    }


def drawn_dpi(width: Column, height: Column, a: Column, b: Column, c: Column, d: Column, unit: Column | None = None) -> Column:
    """The lower of both directions' resolutions of an image that a matrix draws; null where it draws nothing.

    unit: the page's, in points; what is 0 or less counts as 1.
    """
    scale = (F.when(unit > 0, unit).otherwise(F.lit(1.0)) if unit is not None else F.lit(1.0)) / POINTS
    across, down = F.hypot(a, b) * scale, F.hypot(c, d) * scale
    return F.when((across >= NOTHING) & (down >= NOTHING), F.least(width / across, height / down))


def lowest_dpi(placements: DataFrame, image: str, dpi: str = "dpi") -> DataFrame:
    """(image, dpi): the lowest resolution of each image that is drawn at all."""
    return placements.where(F.col(dpi).isNotNull()).groupBy(image).agg(F.min(dpi).alias("dpi"))


def known_only(resolutions: DataFrame, unknown: DataFrame, image: str) -> DataFrame:
    """Resolutions without the images that are drawn in some way that can't be followed: unknown beats known."""
    return resolutions.join(unknown.select(image).distinct(), image, "left_anti")


def mask_dpi(uses: DataFrame, mask: str) -> DataFrame:
    """(mask, dpi) of soft masks from the images that use them (mask, mask_width, width, dpi, unknown): the lowest over
    the parents, -1 where any parent's resolution or width isn't known."""
    good = ~F.coalesce("unknown", F.lit(False)) & (F.col("dpi") > 0) & (F.col("width") > 0) & (F.col("mask_width") > 0)
    own = F.when(good, F.col("dpi") * F.col("mask_width") / F.col("width"))
    sums = uses.groupBy(mask).agg(F.min(own).alias("least"), F.bool_or(~F.coalesce(good, F.lit(False))).alias("poison"))
    return sums.select(mask, F.when(F.col("poison"), F.lit(-1.0)).otherwise(F.col("least")).alias("dpi"))


def also_direct(mask: Column, direct: Column, unknown: Column) -> Column:
    """A mask's resolution where it is drawn by itself as well."""
    return F.when(unknown, F.lit(-1.0)).when((mask > 0) & (direct > 0), F.least(mask, direct)).otherwise(F.coalesce(mask, direct))


def target(size: Column, dpi: Column, most: Column) -> Column:
    """Samples at the wanted resolution, rounded half up, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(size * most / dpi + 0.5))


def downsampled(width: Column, height: Column, dpi: Column, most: Column) -> Column:
    """Struct of the new width and height, or null where resampling doesn't pay or doesn't shrink both."""
    w, h = target(width, dpi, most), target(height, dpi, most)
    pays = (most > 0) & (dpi > 0) & (dpi * 10 > most * WORTH) & (w < width) & (h < height)
    return F.when(pays, F.struct(w.alias("w"), h.alias("h")))


def folded_scale(operators: Column) -> Column:
    """Struct scale and depth after a content stream's operators (array of strings in order): ``q`` saves, ``Q`` restores
    (nothing where there is nothing to restore), a number scales. depth is the deepest nesting. For short arrays;
    :func:`folded_scales` takes streams of any length."""

    def step(s: Column, op: Column) -> Column:
        n = F.size(s["stack"])
        pushed = F.struct(s["scale"].alias("scale"), F.concat(F.array(s["scale"]), s["stack"]).alias("stack"), F.greatest(s["depth"], n + 1).alias("depth"))
        popped = F.struct(F.element_at(s["stack"], 1).alias("scale"), F.slice(s["stack"], 2, F.greatest(n - 1, F.lit(0))).alias("stack"), s["depth"].alias("depth"))
        scaled = F.struct((s["scale"] * op.try_cast("long")).alias("scale"), s["stack"].alias("stack"), s["depth"].alias("depth"))
        return F.when(op == "q", pushed).when(op == "Q", F.when(n > 0, popped).otherwise(s)).otherwise(scaled)

    start = F.struct(F.lit(1).cast("long").alias("scale"), F.expr("cast(array() as array<bigint>)").alias("stack"), F.lit(0).alias("depth"))
    return F.aggregate(operators, start, step, lambda s: F.struct(s["scale"], s["depth"]))


def folded_scales(operators: DataFrame, stream: str, order: list[str], op: str) -> DataFrame:
    """(stream, scale, depth) as :func:`folded_scale` has it, of streams whose operators are a row each. The state of a stream
    is its stack."""

    def step(state: tuple, row: list) -> tuple:
        scale, saved, depth = state  # saved: the scale to restore, what was saved before it, how many
        if row[0] == "q":
            n = saved[2] + 1 if saved else 1
            return scale, (scale, saved, n), max(depth, n)
        if row[0] == "Q":
            return (saved[0], saved[1], depth) if saved else state
        return scale * int(row[0]), saved, depth

    kind = operators.schema[stream].dataType.simpleString()
    rows = operators.select(F.col(op).alias("op"), stream, *[c for c in order if c != stream])
    return folds.folded(rows, stream, order, (1, None, 0), step, f"{stream} {kind}, scale long, depth int", last=lambda s: (s[0], s[2]))
