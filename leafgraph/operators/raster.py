"""Samples of images as arrays: packing, palettes, gray, predictors, runs. All inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Monochrome: at least this many hundredths of the samples at or below DARK, or at or above LIGHT.
DARK, LIGHT, EXTREME = 48, 207, 99
MONO_DPI, MONO_SAMPLES = 150, 250_000
#: Grayness: a spread above COLOR in any pixel is colour; a mean spread up to NEAR is nearly gray.
COLOR, NEAR = 24, 1.5


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def row_bytes(width: Column, parts: Column, bits: Column) -> Column:
    return F.floor((width * parts * bits + 7) / 8)


def unpacked(data: Column, bits: int) -> Column:
    """Samples of an array of bytes, most significant bit first, scaled to 0..255; of 16 bits the high byte."""
    if bits == 8:
        return data
    if bits == 16:
        return F.filter(data, lambda x, i: i % 2 == 0)
    top = (1 << bits) - 1
    of = lambda byte: F.array(*[F.floor(F.shiftright(byte, 8 - bits - at).bitwiseAND(top) * 255 / top).cast("int") for at in range(0, 8, bits)])
    return F.flatten(F.transform(data, of))


def packed(samples: Column, width: int, bits: int = 1) -> Column:
    """Bytes of rows of ``width`` samples below 2**bits; each row ends on a whole byte, zero bits fill it."""
    per = 8 // bits
    across = -(-width // per)
    rows = F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / width).cast("int"))

    def byte(row: Column, k: int) -> Column:
        bit = lambda j: F.shiftleft(F.get(samples, row * width + k * per + j), 8 - bits * (j + 1))
        out = bit(0)
        for j in range(1, per):
            if k * per + j < width:
                out = out.bitwiseOR(bit(j))
        return out

    return F.flatten(F.transform(rows, lambda row: F.array(*[byte(row, k) for k in range(across)])))


def downscaled(samples: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """Area averages, rounded half up. The weights are whole numbers: a source sample spans to_width units across, a
    target sample width of them, so that a target sample covers width * height units."""

    def taps(size: int, to: int, i: int) -> list[tuple[int, int]]:
        return [(s, w) for s in range(size) if (w := min((s + 1) * to, (i + 1) * size) - max(s * to, i * size)) > 0]

    def cell(x: int, y: int) -> Column:
        out = None
        for sy, wy in taps(height, to_height, y):
            for sx, wx in taps(width, to_width, x):
                term = F.get(samples, F.lit(sy * width + sx)) * (wx * wy)
                out = term if out is None else out + term
        area = width * height
        return F.floor((out * 2 + area) / (2 * area)).cast("int")

    return F.array(*[cell(x, y) for y in range(to_height) for x in range(to_width)])


def palette(colors: Column) -> Column:
    """Distinct values by first appearance."""
    return F.array_distinct(colors)


def indexed(colors: Column) -> Column:
    """Each value's place in the palette, from 0."""
    return F.transform(colors, lambda c: (F.array_position(palette(colors), c) - 1).cast("int"))


def expanded(indices: Column, colors: Column) -> Column:
    return F.transform(indices, lambda i: F.get(colors, i))


def bits_for(count: Column) -> Column:
    return F.when(count <= 2, 1).when(count <= 4, 2).when(count <= 16, 4).otherwise(8)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def cmyk_gray(c: Column, m: Column, y: Column, k: Column) -> Column:
    return (255 - F.least(F.lit(255), F.floor((30 * c + 59 * m + 11 * y) / 100).cast("int") + k)).cast("int")


def pixels(samples: Column, parts: int, n: int) -> Column:
    """Array of arrays: n pixels of ``parts`` samples each."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(samples, i * parts + 1, F.lit(parts)))


def grayness(spreads: Column) -> Column:
    """Color, Exact or Near from each pixel's largest less smallest part; no pixel is Exact."""
    mean = total(spreads) / F.greatest(F.size(spreads), F.lit(1))
    return (
        F.when(F.exists(spreads, lambda s: s > COLOR), "Color")
        .when(F.forall(spreads, lambda s: s == 0), "Exact")
        .when(mean <= NEAR, "Near")
        .otherwise("Color")
    )


def gray_bits(samples: Column) -> Column:
    """Fewest bits that hold gray samples exactly."""
    return (
        F.when(F.forall(samples, lambda v: v.isin(0, 255)), 1)
        .when(F.forall(samples, lambda v: v % 85 == 0), 2)
        .when(F.forall(samples, lambda v: v % 17 == 0), 4)
        .otherwise(8)
    )


def few_levels(samples: Column, bits: Column) -> Column:
    """Samples as levels of 1, 2, 4 or 8 bits."""
    step = F.when(bits == 1, 255).when(bits == 2, 85).when(bits == 4, 17).otherwise(1)
    return F.transform(samples, lambda v: F.floor(v / step).cast("int"))


def extremes(samples: Column) -> Column:
    """How many samples are nearly black or nearly white."""
    return F.size(F.filter(samples, lambda v: (v <= DARK) | (v >= LIGHT)))


def mostly_extreme(samples: Column, percent: int = EXTREME) -> Column:
    return extremes(samples) >= F.floor(F.size(samples) * percent / 100)


def monochrome(samples: Column, dpi: Column, percent: int = EXTREME, least: int = MONO_SAMPLES) -> Column:
    """Whether a gray image is a scan that two levels can stand for."""
    return (dpi >= MONO_DPI) & (F.size(samples) >= least) & mostly_extreme(samples, percent)


def thresholded(samples: Column) -> Column:
    return F.transform(samples, lambda v: F.when(v >= 128, 255).otherwise(0))


def bilevel(samples: Column) -> Column:
    return F.forall(samples, lambda v: v.isin(0, 255))


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Of left, up and up-left the nearest to a + b - c; ties go to the first."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def predicted(samples: Column, width: int, step: int = 1) -> Column:
    """For each sample an array of the five PNG filters' bytes: none, left, up, average, Paeth. What lies outside is 0."""

    def at(i: Column, back: int, up: int) -> Column:
        inside = (i % width >= back) & (i >= up * width)
        return F.when(inside, F.get(samples, i - back - up * width)).otherwise(0)

    def filters(v: Column, i: Column) -> Column:
        a, b, c = at(i, step, 0), at(i, 0, 1), at(i, step, 1)
        guesses = [F.lit(0), a, b, F.floor((a + b) / 2).cast("int"), paeth(a, b, c)]
        return F.array(*[F.pmod(v - g, F.lit(256)) for g in guesses])

    return F.transform(samples, filters)


def filter_cost(values: Column) -> Column:
    """Sum of magnitudes of bytes read as signed."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + F.when(v < 128, v).otherwise(256 - v))


def best_filter(samples: Column, width: int, rows: int) -> Column:
    """For each row the PNG filter of least cost, the lowest of equals."""

    def cheapest(all_: Column, y: Column) -> Column:
        row = F.slice(all_, y * width + 1, F.lit(width))
        costs = F.transform(F.array(F.array(*[_cost(row, f) for f in range(5)])), lambda c: F.array_position(c, F.array_min(c)) - 1)
        return F.element_at(costs, 1).cast("int")

    # the one-element arrays bind what is used more than once to a name
    per_row = lambda all_: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda y: cheapest(all_, y))
    return F.element_at(F.transform(F.array(predicted(samples, width)), per_row), 1)


def _cost(row: Column, f: int) -> Column:
    return filter_cost(F.transform(row, lambda v: v[f]))


def decoded(sample: Column, low: float, high: float) -> Column:
    """A sample under a Decode pair, back to 0..255, rounded half up."""
    x = (low + sample / 255.0 * (high - low)) * 255.0
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5).cast("int")))


def default_decode(decode: Column, parts: int, bits: int, indexed_: bool = False) -> Column:
    usual = [0.0, float((1 << bits) - 1)] if indexed_ else [0.0, 1.0] * parts
    return decode.isNull() | (decode == F.array(*map(F.lit, usual)))


def run_lengths(row: Column) -> Column:
    """Lengths of the runs of equal values, in order."""

    def step(s: Column, v: Column) -> Column:
        n = F.size(s["runs"])
        longer = F.concat(F.slice(s["runs"], F.lit(1), n - 1), F.array(F.element_at(s["runs"], -1) + 1))
        runs = F.when((n > 0) & s["last"].eqNullSafe(v), longer).otherwise(F.concat(s["runs"], F.array(F.lit(1))))
        return F.struct(runs.alias("runs"), v.alias("last"))

    start = F.struct(F.expr("cast(array() as array<int>)").alias("runs"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(row, start, step, lambda s: s["runs"])


def repeats(samples: Column, width: int, rows: int) -> Column:
    """For each row whether it equals the row above; above the first are zeros."""
    row = lambda y: F.slice(samples, y * width + 1, F.lit(width))
    blank = F.array(*[F.lit(0)] * width)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda y: row(y) == F.when(y == 0, blank).otherwise(row(F.greatest(y - 1, F.lit(0)))))


def toggles(same: Column) -> Column:
    """What a typical-prediction coder writes for each row: whether ``same`` has changed, from false on."""
    return F.transform(same, lambda s, i: s != F.when(i == 0, F.lit(False)).otherwise(F.get(same, F.greatest(i - 1, F.lit(0)))))
