"""Compression profiles: built-in ones, overrides, defaults, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id INT, name STRING, is_built_in BOOLEAN, compress_images BOOLEAN, image_quality DOUBLE, max_resolution INT, "
    "monochrome_scans BOOLEAN, grayscale BOOLEAN, remove_metadata BOOLEAN, remove_editing_data BOOLEAN, "
    "remove_annotations BOOLEAN, remove_bookmarks BOOLEAN, remove_attachments BOOLEAN, remove_javascript BOOLEAN"
)
FLAGS = ("monochrome_scans", "grayscale", "remove_metadata", "remove_editing_data", "remove_annotations", "remove_bookmarks", "remove_attachments", "remove_javascript")
#: What a stored profile without the field gets; without max_resolution it keeps the original one (null).
DEFAULTS = {"is_built_in": False, "compress_images": True, "image_quality": 0.6, **dict.fromkeys(FLAGS, False)}
#: Fixed values.
BUILT_IN = [
    {"id": 1, "name": "Lossless", "compress_images": False, "image_quality": 1.0, "max_resolution": None},
    {"id": 2, "name": "Low", "image_quality": 0.8, "max_resolution": 300},
    {"id": 3, "name": "Medium", "image_quality": 0.6, "max_resolution": 150, "remove_editing_data": True},
    {"id": 4, "name": "High", "image_quality": 0.4, "max_resolution": 110, "monochrome_scans": True, "remove_metadata": True, "remove_editing_data": True},
    {"id": 5, "name": "Maximum", "image_quality": 0.2, "max_resolution": 72, "monochrome_scans": True, "remove_metadata": True, "remove_editing_data": True},
]


def built_in(spark: SparkSession) -> DataFrame:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = [tuple((DEFAULTS | {"is_built_in": True} | p).get(n) for n in names) for p in BUILT_IN]
    return spark.createDataFrame(rows, SCHEMA)


def parsed(json: Column) -> Column:
    """A stored profile; missing fields take their defaults, what can't be read is null."""

    def filled(raw: Column) -> Column:
        fields = [F.coalesce(raw[n], F.lit(DEFAULTS[n])).alias(n) if n in DEFAULTS else raw[n].alias(n) for n in (f.split()[0] for f in SCHEMA.split(", "))]
        return F.when(raw["id"].isNotNull() & raw["name"].isNotNull(), F.struct(*fields))

    return F.transform(F.array(F.from_json(json, SCHEMA)), filled)[0]  # the text is read once, not for each field


def effective(base: DataFrame, stored: DataFrame) -> DataFrame:
    """Built-in profiles with their stored overrides (columns as in SCHEMA): a stored profile replaces the whole built-in of
    its id; ids that aren't built in are ignored. Of several of one id the first by name counts. ``base`` is small: what is
    stored for other ids goes where it is read, and only the rest is sorted and meets."""
    names = base.columns
    mine, theirs = F.col("id"), F.col("_id")
    known = stored.join(F.broadcast(base.select(mine.alias("_id"))), mine.eqNullSafe(theirs), "left_semi")
    one = known.groupBy(mine.alias("_id")).agg(F.min_by(F.struct(*[n for n in names if n != "id"]), "name").alias("own"))
    met = base.join(F.broadcast(one), mine.eqNullSafe(theirs), "left")  # plain equality would have Spark make each id twice, first to drop null ones
    return met.select("id", *[F.when(F.col("own").isNotNull(), F.col(f"own.{n}")).otherwise(F.col(n)).alias(n) for n in names if n != "id"])


def upserted(stored: DataFrame, changed: DataFrame, base: DataFrame) -> DataFrame:
    """Stored overrides after a change: of one id only, and none that equals its built-in or that has none."""
    rest = stored.join(changed.select("id"), "id", "left_anti")
    fresh = changed.join(base.select("id"), "id", "left_semi").select(*base.columns).exceptAll(base)
    return rest.select(*base.columns).unionByName(fresh)


def percent(quality: Column) -> Column:
    """Quality 0..1 as a whole percentage from 1 to 100, half up."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality))
    return F.least(F.lit(100), F.greatest(F.lit(1), F.floor(clamped * 100 + 0.5).cast("int")))


def summary(p: dict[str, Column]) -> Column:
    """Such as ``150 dpi · JPEG 60% · Grayscale · No metadata``."""
    size = F.coalesce(F.concat(p["max_resolution"].cast("string"), F.lit(" dpi")), F.lit("Original resolution"))
    jpeg = F.concat(F.lit("JPEG "), F.floor(p["image_quality"] * 100 + 0.5).cast("string"), F.lit("%"))
    return F.concat_ws(
        " · ",
        F.when(p["compress_images"], size).otherwise("Lossless"),
        F.when(p["compress_images"], jpeg),
        F.when(p["grayscale"], "Grayscale"),
        F.when(p["remove_metadata"], "No metadata"),
    )


def nearest(target: Column, places: int) -> Column:
    """The nearest of evenly spaced places 0..places-1 to a target from 0 to 1; of two the lower."""
    far = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.abs(target * (places - 1) - i))
    return F.array_position(far, F.array_min(far)).cast("int") - 1


def stepped(index: Column, step: int, places: int) -> Column:
    return F.least(F.lit(places - 1), F.greatest(F.lit(0), index + step))


def dial_angle(level: Column) -> Column:
    """Degrees of a level from 0 to 1 on a dial open at the bottom."""
    return 135 + 270 * level


def options(sizes: list[int], own: Column) -> Column:
    """The offered resolutions with the profile's own, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, sizes)), F.array(own))))
