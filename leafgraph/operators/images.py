"""Which images can be recompressed, and the encodings worth trying for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SAMPLES = 200_000_000
#: Up to so many bytes both with and without prediction.
BOTH = 4 << 20
LEAST_JPEG, MOST_COLORS = 4096, 256
OPAQUE = ("/JPXDecode", "/JBIG2Decode", "/CCITTFaxDecode", "/Crypt")


def reject_reason(c: dict[str, Column]) -> Column:
    """Why an image is left alone, null if it is not. c: width, height, bits, filters, is_mask, indexed, color_transform,
    jpeg (struct width, height, precision, or null), data_bytes (decoded), row_bytes."""
    jpegs = F.size(F.filter(c["filters"], lambda f: f == "/DCTDecode"))
    jpeg = jpegs > 0
    return (
        F.when((c["width"] <= 0) | (c["height"] <= 0), "empty")
        .when(c["width"].cast("long") * c["height"] > MOST_SAMPLES, "too large")
        .when(F.arrays_overlap(c["filters"], F.array(*map(F.lit, OPAQUE))), "codec")
        .when(jpeg & ((jpegs > 1) | (F.element_at(c["filters"], -1) != "/DCTDecode")), "codec order")
        .when(jpeg & c["is_mask"], "mask as JPEG")
        .when(~c["bits"].isin(1, 2, 4, 8, 16), "depth")
        .when(c["indexed"] & ((c["bits"] == 16) | jpeg), "indexed")
        .when(jpeg & c["color_transform"].isNotNull(), "colour transform")
        .when(jpeg & ~F.coalesce((c["jpeg.width"] == c["width"]) & (c["jpeg.height"] == c["height"]) & (c["jpeg.precision"] == 8), F.lit(False)), "JPEG header")
        .when(~jpeg & (c["data_bytes"] < c["row_bytes"] * c["height"]), "truncated")
    )


def can_recolor(color_key: Column, matte: Column, default_decode: Column, indexed: Column) -> Column:
    return ~color_key & ~matte & (default_decode | ~indexed)


def to_gray(recolor: Column, family: Column, grayness: Column, lossy: Column, wanted: Column) -> Column:
    """Whether a colour image becomes gray; only RGB can be gray by itself."""
    by_itself = (family == "RGB") & ((grayness == "Exact") | (grayness == "Near") & lossy)
    return recolor & family.isin("RGB", "CMYK") & (by_itself | wanted)


def jpeg_worth(lossy: Column, is_smask: Column, bilevel: Column, color_key: Column, indexed: Column, samples: Column, family: Column, was_jpeg: Column) -> Column:
    kinds = family.isin("Gray", "RGB") | (family == "CMYK") & was_jpeg
    return lossy & ~is_smask & ~bilevel & ~color_key & ~indexed & (samples >= LEAST_JPEG) & kinds


def flate_tries(bits: Column, size: Column, predictor: Column) -> Column:
    """Names of the lossless encodings to try: deflated plain and predicted, and the two codecs for one bit."""
    names = [
        F.when(~predictor | (size <= BOTH), "flate"),
        F.when(predictor | ((bits < 8) & (size <= BOTH)), "flate predicted"),
        F.when(bits == 1, "g4"),
        F.when(bits == 1, "jbig2"),
    ]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def tries(images: DataFrame, key: str, names: Column) -> DataFrame:
    """A row for each encoding to try of each image: key, ordinal, label."""
    return images.select(key, F.posexplode(names).alias("ordinal", "label"))


def color_space(name: Column, parts: Column) -> Column:
    """Struct family and n of a colour space by its name; ICCBased and DeviceN ones go by their parts."""
    by_parts = F.when(parts == 1, "Gray").when(parts == 3, "RGB").when(parts == 4, "CMYK").otherwise("Other")
    family = (
        F.when(name.isin("/DeviceGray", "/CalGray", "/G"), "Gray")
        .when(name.isin("/DeviceRGB", "/CalRGB", "/RGB"), "RGB")
        .when(name.isin("/DeviceCMYK", "/CMYK"), "CMYK")
        .when(name == "/ICCBased", by_parts)
        .otherwise("Other")
    )
    n = F.when(family == "Gray", 1).when(family == "RGB", 3).when(family == "CMYK", 4).when(name == "/Lab", 3).when(name == "/Separation", 1).otherwise(parts)
    return F.when(n <= 32, F.struct(family.alias("family"), n.alias("n")))
