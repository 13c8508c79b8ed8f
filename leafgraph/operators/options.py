"""Choices of a run: profiles by name, overrides, copies, where results go, what a file's state means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a run by its code.
ERRORS = {1: "cannotOpen", 2: "passwordRequired", 3: "wrongPassword", 4: "writeFailed", 6: "cancelled"}
SUFFIX = "-compressed"


def by_name(asked: DataFrame, name: str, profiles: DataFrame) -> DataFrame:
    """``asked`` with the profile (``profile_id``) of its name in any case, null for unknown ones. Of several profiles of one name the
    smallest id counts."""
    keyed = profiles.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("profile_id"))
    return asked.join(keyed, F.lower(asked[name]) == F.col("_name"), "left").drop("_name")


def overridden(quality: Column, resolution: Column, compress: Column, own_quality: Column, own_resolution: Column) -> Column:
    """Struct compress, quality (0 to 1), resolution: a profile's with a run's own quality (0 to 100) and resolution, null for none. Either
    switches compression of images on; values out of range make the whole null."""
    good = F.coalesce(own_quality.between(0, 100), F.lit(True)) & F.coalesce(own_resolution > 0, F.lit(True))
    return F.when(
        good,
        F.struct(
            (compress | own_quality.isNotNull() | own_resolution.isNotNull()).alias("compress"),
            F.coalesce(own_quality / 100, quality).alias("quality"),
            F.coalesce(own_resolution, resolution).alias("resolution"),
        ),
    )


def duplicate(profiles: DataFrame, ids: Column, name: Column | None = None) -> DataFrame:
    """Copies of profiles that can be edited: new ids, a given name or the old one with ``Copy``, not built in."""
    fresh = F.concat(F.col("name"), F.lit(" Copy"))
    return profiles.withColumns({"id": ids, "name": fresh if name is None else F.coalesce(name, fresh), "is_built_in": F.lit(False)})


def location(destination: Column, folder: Column) -> Column:
    """Where results go: ``folder`` only with one chosen, else beside the originals."""
    return F.when(destination == "replace", "replace").when((destination == "folder") & folder.isNotNull(), "folder").otherwise("sameFolder")


def destination_text(destination: Column, folder: Column, suffix: Column) -> Column:
    beside = F.concat(F.lit("Saved next to originals as “name"), F.when(suffix == "", SUFFIX).otherwise(suffix), F.lit(".pdf”"))
    chosen = F.concat(F.lit("Saved to "), F.element_at(F.split(folder, "/"), -1))
    return (
        F.when(destination == "replace", "Originals are replaced (moved to the Trash)")
        .when(destination == "folder", F.coalesce(chosen, F.lit("No output folder chosen")))
        .otherwise(beside)
    )


def shown(original: Column, made: Column, kept: Column) -> Column:
    """The file to show: what was made, unless the original was kept or nothing was made."""
    return F.when(made.isNotNull() & ~F.coalesce(kept, F.lit(False)), made).otherwise(original)


def error(code: Column) -> Column:
    """The kind of error of a code, null for 0."""
    out = F.when(code == 0, F.lit(None).cast("string"))
    for n, kind in ERRORS.items():
        out = out.when(code == n, kind)
    return out.otherwise("failed")


def title(files: Column, again: Column) -> Column:
    """The button of a batch: ``Compress 1 File``, ``Compress 3 Files Again``."""
    count = F.when(files == 1, "1 File").otherwise(F.concat(files.cast("string"), F.lit(" Files")))
    return F.concat(F.lit("Compress "), count, F.when(again, " Again").otherwise(""))


def index_bits(largest: Column, key: Column) -> Column:
    """Bits of an indexed image's samples by its largest index and the largest value of its colour key (null without one)."""
    count = F.greatest(largest, F.coalesce(key, F.lit(0))) + 1
    return F.when(count <= 2, 1).when(count <= 4, 2).when(count <= 16, 4).otherwise(8)


def may_reduce(bits: Column, lossy: Column, key: Column) -> Column:
    """Whether an image may be held in eight bits: 16 only by loss, and not with a colour key."""
    return (bits != 16) | (lossy & ~key)
