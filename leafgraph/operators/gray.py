"""Rewriting colour operators of page content to gray."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators that set a colour, with the operands they take, and the gray operator for each.
COLOR_OPERATORS = {"rg": (3, "g"), "RG": (3, "G"), "k": (4, "g"), "K": (4, "G"), "g": (1, "g"), "G": (1, "G")}


def rgb_gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def cmyk_gray(c: Column, m: Column, y: Column, k: Column) -> Column:
    return 1.0 - F.least(F.lit(1.0), 0.3 * c + 0.59 * m + 0.11 * y + k)


def number(x: Column) -> Column:
    """0 to 1 with four decimals at most, half up, without zeros or a point at the end."""
    scaled = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 10000 + 0.5 + 1e-7).cast("long")
    text = F.concat(F.floor(scaled / 10000).cast("string"), F.lit("."), F.lpad((scaled % 10000).cast("string"), 4, "0"))
    return F.regexp_replace(text, r"\.?0+$", "")


def device_kind(space: Column) -> Column:
    """Gray, RGB, CMYK or Pattern of a colour space's name; null for others."""
    return (
        F.when(space.isin("DeviceGray", "G", "CalGray"), "Gray")
        .when(space.isin("DeviceRGB", "RGB", "CalRGB"), "RGB")
        .when(space.isin("DeviceCMYK", "CMYK"), "CMYK")
        .when(space == "Pattern", "Pattern")
    )


def rewritten(content: Column) -> Column:
    """A run of operands and one operator, separated by blanks: colour-setting operators with as many numbers as they take
    become gray ones; everything else stays as it is."""
    tokens = F.filter(F.split(content, r"\s+"), lambda t: t != "")
    op = F.element_at(tokens, -1)
    values = F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - 1), lambda t: t.try_cast("double"))
    good = lambda n: (F.size(values) == n) & F.forall(values, lambda v: v.isNotNull())
    rgb = number(rgb_gray(F.get(values, F.lit(0)), F.get(values, F.lit(1)), F.get(values, F.lit(2))))
    cmyk = number(cmyk_gray(*[F.get(values, F.lit(i)) for i in range(4)]))
    return (
        F.when(op.isin("rg", "RG") & good(3), F.concat_ws(" ", rgb, F.when(op == "rg", "g").otherwise("G")))
        .when(op.isin("k", "K") & good(4), F.concat_ws(" ", cmyk, F.when(op == "k", "g").otherwise("G")))
        .otherwise(content)
    )
