"""Pages of documents, what their content draws, and how large each image is drawn.

All functions take the objects of :func:`leafgraph.sources.documents.objects`, of any number of files, and join by file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgraph.functions import content, filters
from leafgraph.operators import placement
from leafgraph.session import written

#: Levels of a page tree, of forms within forms, and of forms whose images are marked as unknown.
TREE, FORMS, MARKED = 64, 24, 8
MATRIX = ("a", "b", "c", "d", "e", "f")


def links(found: DataFrame) -> DataFrame:
    """file_id, obj, path, dst: the references of every object."""
    return found.select("file_id", "obj", F.explode("refs").alias("r")).select("file_id", "obj", "r.path", "r.dst")


def entry(key: str) -> Column:
    """An entry of an object's dictionary as text."""
    return F.get_json_object("body", f"$.{key}")


def roots(found: DataFrame) -> DataFrame:
    """file_id, obj: the catalog of each file."""
    return links(found).where("obj = 0 and path = '/Root'").select("file_id", F.col("dst").alias("obj"))


def pages(found: DataFrame) -> DataFrame:
    """file_id, obj, ordinal (from 1), owner: the leaves of each page tree in their order; ``owner`` is the page itself or its nearest
    ancestor with resources, null without any. A page that the tree names twice counts once, at its first place; loops end."""
    link = links(found)
    own = found.select("file_id", "obj", entry("Resources").isNotNull().alias("has"))
    kids = link.where(F.col("path").rlike("^/Kids/[0-9]+$")).select("file_id", "obj", "dst", F.substring("path", 7, 9).try_cast("int").alias("k"))
    top = link.where("path = '/Pages'").join(roots(found), ["file_id", "obj"], "left_semi").select("file_id", F.col("dst").alias("obj"))
    start = F.expr("cast(array() as array<int>)")
    level = top.distinct().join(own, ["file_id", "obj"]).select("file_id", "obj", start.alias("place"), F.when(F.col("has"), F.col("obj")).alias("owner"))
    seen = [written(level, "pages")]
    while len(seen) <= TREE:
        known = seen[0]
        for other in seen[1:]:
            known = known.unionByName(other)
        below = seen[-1].join(kids, ["file_id", "obj"]).select("file_id", F.col("dst").alias("obj"), F.concat("place", F.array("k")).alias("place"), "owner")
        first = below.groupBy("file_id", "obj").agg(F.min(F.struct("place", "owner")).alias("at")).join(known, ["file_id", "obj"], "left_anti")
        step = first.join(own, ["file_id", "obj"]).select("file_id", "obj", "at.place", F.when(F.col("has"), F.col("obj")).otherwise(F.col("at.owner")).alias("owner"))
        step = written(step, "pages")
        if step.isEmpty():
            break
        seen.append(step)
    out = seen[0]
    for other in seen[1:]:
        out = out.unionByName(other)
    leaves = out.join(found.where((F.col("kind") == "dictionary") & entry("Kids").isNull()), ["file_id", "obj"], "left_semi")
    return leaves.select("file_id", "obj", F.row_number().over(W.partitionBy("file_id").orderBy("place")).alias("ordinal"), "owner")


def contents(found: DataFrame, leaves: DataFrame) -> DataFrame:
    """file_id, owner, part, obj, kind: the streams with page content: those of pages in their order, forms, tiling patterns and
    glyphs of Type 3 fonts. A stream that several own is there for each."""
    link = links(found)
    page = leaves.select("file_id", F.col("obj").alias("owner"))
    of = page.join(link.withColumnRenamed("obj", "owner"), ["file_id", "owner"])
    part = lambda skip: F.substring("path", skip, 9).try_cast("int")
    direct = of.where(F.col("path").rlike("^/Contents(/[0-9]+)?$")).select("file_id", "owner", F.coalesce(part(11), F.lit(0)).alias("part"), F.col("dst").alias("obj"))
    listed = direct.join(link.where(F.col("path").rlike("^/[0-9]+$")), ["file_id", "obj"]).select("file_id", "owner", part(2).alias("part"), F.col("dst").alias("obj"))
    own = found.where((F.col("kind") == "stream") & ((entry("Subtype") == "/Form") | (entry("PatternType") == "1")))
    fonts = found.where(entry("Subtype") == "/Type3").select("file_id", "obj")
    glyphs = link.where(F.col("path").rlike("^/CharProcs/[^/]+$")).join(fonts, ["file_id", "obj"], "left_semi")
    rows = [
        direct.withColumn("kind", F.lit("page")),
        listed.withColumn("kind", F.lit("page")),
        own.select("file_id", F.col("obj").alias("owner"), F.lit(0).alias("part"), "obj", F.when(entry("Subtype") == "/Form", "form").otherwise("pattern").alias("kind")),
        glyphs.select("file_id", F.col("obj").alias("owner"), F.lit(0).alias("part"), F.col("dst").alias("obj"), F.lit("glyph").alias("kind")),
    ]
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out.join(found.where("kind = 'stream'").select("file_id", "obj"), ["file_id", "obj"], "left_semi")


def draws(found: DataFrame, parts: DataFrame) -> DataFrame:
    """file_id, owner, name, a to f: each drawing of a named object by the content of a page or form, with the matrix there. The
    parts of a page, which share its state, meet in one row."""
    raw = found.select("file_id", "obj", "raw", "filters", entry("DecodeParms").alias("parms"))
    rows = parts.where("kind in ('page', 'form')").join(raw, ["file_id", "obj"]).groupBy("file_id", "owner")
    joined = rows.agg(F.array_sort(F.collect_list(F.struct("part", "obj", "raw", "filters", "parms"))).alias("parts"))
    schema = "file_id string, owner int, name string, " + ", ".join(f"{c} double" for c in MATRIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, owner, own in zip(*[c.to_pylist() for c in batch.columns]):
                text = b"\n".join(filters.plain(p["raw"], p["filters"], p["parms"]) or b"" for p in own)
                out += [(file_id, owner, name, *map(float, at)) for name, at in content.draws(text)]
            yield pa.RecordBatch.from_pylist([dict(zip(["file_id", "owner", "name", *MATRIX], r)) for r in out], schema=into)

    into = pa.schema([("file_id", pa.string()), ("owner", pa.int32()), ("name", pa.string()), *[(c, pa.float64()) for c in MATRIX]])
    return joined.mapInArrow(run, schema)


def resources(found: DataFrame, kind: str) -> DataFrame:
    """file_id, owner, name, dst: what the names of a kind of resources (``XObject``) mean to each owner of resources. Dictionaries on
    the way may be objects of their own."""
    link = links(found)
    step = lambda rows, path: rows.join(link.where(F.col("path") == path).withColumnRenamed("obj", "at"), ["file_id", "at"]).select("file_id", "owner", F.col("dst").alias("at"))
    every = found.where(entry("Resources").isNotNull()).select("file_id", F.col("obj").alias("owner"), F.col("obj").alias("at"))
    apart = step(every, "/Resources")
    alone = step(every, f"/Resources/{kind}").unionByName(step(apart, f"/{kind}"))
    held = [(every, f"/Resources/{kind}/"), (apart, f"/{kind}/"), (alone, "/")]
    out = None
    for rows, before in held:
        name = F.expr(f"substring(path, {len(before) + 1})")
        own = link.where(F.col("path").startswith(before) & ~F.contains(name, F.lit("/"))).select("file_id", F.col("obj").alias("at"), name.alias("name"), "dst")
        met = rows.join(own, ["file_id", "at"]).select("file_id", "owner", "name", "dst")
        out = met if out is None else out.unionByName(met)
    return out


def resolutions(found: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """file_id, image, dpi: the lowest resolution at which pages draw each image; -1 where some use can't be followed: a form that
    draws itself or forms nested too deeply. Forms are followed level by level, equal drawings once; those without resources have
    those of their caller. Soft masks have the resolution of the images that use them. Images that nothing draws have no row."""
    leaves = pages(found) if leaves is None else leaves
    drawn = written(draws(found, contents(found, leaves)), "draws")
    size = found.where("kind = 'stream'").select("file_id", F.col("obj").alias("dst"), entry("Subtype").alias("subtype"), entry("Matrix").alias("own"), entry("Resources").isNotNull().alias("has"))
    named = written(resources(found, "XObject").join(size, ["file_id", "dst"]).where("subtype in ('/Image', '/Form')"), "resources")
    unit = found.select("file_id", "obj", entry("UserUnit").try_cast("double").alias("unit"))
    one = dict(zip(MATRIX, (1, 0, 0, 1, 0, 0)))
    level = leaves.join(unit, ["file_id", "obj"]).select(
        "file_id", F.col("obj").alias("owner"), F.col("owner").alias("res"), "unit", F.array("obj").alias("route"), *[F.lit(float(v)).alias(f"at_{c}") for c, v in one.items()]
    )
    images, lost = [], []
    for _ in range(FORMS + 1):
        met = level.join(drawn, ["file_id", "owner"]).join(named.withColumnRenamed("owner", "res"), ["file_id", "res", "name"])
        total = placement.product({c: F.col(c) for c in MATRIX}, {c: F.col(f"at_{c}") for c in MATRIX})
        met = written(met.select("file_id", "res", "dst", "subtype", "own", "has", "unit", "route", *[total[c].alias(c) for c in MATRIX]), "drawn")
        images.append(met.where("subtype = '/Image'").select("file_id", F.col("dst").alias("image"), "unit", *MATRIX))
        forms = met.where("subtype = '/Form'").withColumn("res", F.when(F.col("has"), F.col("dst")).otherwise(F.col("res")))
        lost.append(forms.where(F.array_contains("route", F.col("dst"))).select("file_id", F.col("res").alias("owner")))
        own = F.from_json("own", "array<double>")
        inner = placement.product({c: F.coalesce(F.get(own, F.lit(i)), F.lit(float(one[c]))) for i, c in enumerate(MATRIX)}, {c: F.col(c) for c in MATRIX})
        level = forms.where(~F.array_contains("route", F.col("dst"))).select(
            "file_id", F.col("dst").alias("owner"), "res", "unit", F.concat("route", F.array("dst")).alias("route"), *[inner[c].alias(f"at_{c}") for c in MATRIX]
        ).distinct()
        level = written(level, "forms")
        if level.isEmpty():
            break
    lost.append(level.select("file_id", F.col("res").alias("owner")))
    bits = found.select("file_id", F.col("obj").alias("image"), entry("Width").try_cast("int").alias("width"), entry("Height").try_cast("int").alias("height"))
    rows = _all(images).join(bits.where("width is not null and height is not null"), ["file_id", "image"])
    dpi = rows.select("file_id", "image", placement.drawn_dpi(F.col("width"), F.col("height"), *[F.col(c) for c in "abcd"], F.col("unit")).alias("dpi"))
    direct = dpi.where("dpi is not null").groupBy("file_id", "image").agg(F.min("dpi").alias("dpi"))
    unknown = _marked(_all(lost).distinct(), named)
    own = direct.unionByName(unknown).groupBy("file_id", "image").agg(F.min("dpi").alias("dpi"))
    own = written(own, "dpi")
    uses = links(found).where("path = '/SMask'").select("file_id", F.col("obj").alias("image"), F.col("dst").alias("mask"))
    uses = uses.join(bits, ["file_id", "image"]).join(bits.select("file_id", F.col("image").alias("mask"), F.col("width").alias("mask_width")), ["file_id", "mask"])
    uses = uses.join(own, ["file_id", "image"], "left").select(F.struct("file_id", F.col("mask").alias("image")).alias("mask"), "mask_width", "width", F.coalesce("dpi", F.lit(-1.0)).alias("dpi"), F.lit(False).alias("unknown"))
    masks = placement.mask_dpi(uses, "mask").select("mask.*", F.col("dpi").alias("by_use"))
    met = own.join(masks, ["file_id", "image"], "full")
    poisoned = (F.col("dpi") < 0) | (F.col("by_use") < 0)
    return met.select("file_id", "image", placement.also_direct(F.col("by_use"), F.col("dpi"), F.coalesce(poisoned, F.lit(False))).alias("dpi"))


def _marked(owners: DataFrame, named: DataFrame) -> DataFrame:
    """file_id, image, dpi -1: the images that resources name, and those of the forms that they name."""
    found = []
    for _ in range(MARKED + 1):
        met = owners.join(named, ["file_id", "owner"])
        found.append(met.where("subtype = '/Image'").select("file_id", F.col("dst").alias("image"), F.lit(-1.0).alias("dpi")))
        owners = written(met.where("subtype = '/Form' and has").select("file_id", F.col("dst").alias("owner")).distinct(), "marked")
        if owners.isEmpty():
            break
    return _all(found).distinct()


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out
