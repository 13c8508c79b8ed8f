"""Whole documents made smaller: parts stripped, equal streams merged, images and other streams encoded anew, and written.

Every stage takes and returns the objects of :func:`leafgraph.sources.documents.objects` of any number of files, so that work is
shared out by objects, not by files. A file that can't be read, or does not become smaller, stays as it is.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgraph.functions import content, filters
from leafgraph.operators import dedup, graph, images, pages, placement, prune
from leafgraph.operators.pages import entry, links
from leafgraph.session import written
from leafgraph.sources import documents

SCRIPT, ATTACHED = "/JavaScript", "/FileAttachment"
#: Rounds in which streams that became equal by references to equal ones are merged.
ROUNDS = 8


def removals(found: DataFrame, names: list[str]) -> DataFrame:
    """file_id, obj, paths: what stripping ``names`` (of prune.STRIPPABLE) takes out of each object, as paths such as ``/Names/JavaScript``.
    Actions go only if they are scripts, page modes only if they show what goes; both may be objects of their own."""
    has = set(names)
    link = links(found)
    rows = []

    def cut(of: DataFrame, path: str, when: Column | None = None) -> None:
        rows.append((of if when is None else of.where(when)).select("file_id", "obj", F.lit(path).alias("path")))

    to = lambda of, path: of.join(link.where(F.col("path") == path), ["file_id", "obj"]).select("file_id", F.col("dst").alias("obj"))
    whole = lambda of: found.join(of.select("file_id", "obj").distinct(), ["file_id", "obj"], "left_semi")
    top, every = whole(pages.roots(found)), found.where("kind in ('dictionary', 'stream')")
    listed = whole(to(top, "/Names"))
    scripts = found.where(entry("S") == SCRIPT).select("file_id", F.col("obj").alias("dst"))
    leaves = whole(pages.pages(found)) if has & {"annotations", "attachments", "editing"} else None
    if "metadata" in has:
        cut(found.where("obj = 0"), "/Info")
        cut(every, "/Metadata")
    if "bookmarks" in has:
        cut(top, "/Outlines")
        cut(top, "/PageMode", entry("PageMode") == "/UseOutlines")
    if "annotations" in has:
        cut(top, "/AcroForm")
        cut(leaves, "/Annots")
    if "attachments" in has:
        cut(top, "/Names/EmbeddedFiles")
        cut(listed, "/EmbeddedFiles")
        cut(top, "/Collection")
        cut(top, "/PageMode", entry("PageMode") == "/UseAttachments")
        cut(every, "/AF")
        if "annotations" not in has:
            attached = found.where(entry("Subtype") == ATTACHED).select("file_id", F.col("obj").alias("dst"))
            inside = link.join(leaves, ["file_id", "obj"], "left_semi").where(F.col("path").rlike("^/Annots/[0-9]+$"))
            apart = link.join(to(leaves, "/Annots"), ["file_id", "obj"], "left_semi").where(F.col("path").rlike("^/[0-9]+$"))
            rows.append(inside.unionByName(apart).join(attached, ["file_id", "dst"], "left_semi").select("file_id", "obj", "path"))
            own = F.expr("cast(try_parse_json(get_json_object(body, '$.Annots')) as array<variant>)")
            direct = F.filter(F.transform(own, lambda x, i: F.when(F.try_variant_get(x, "$.Subtype", "string") == ATTACHED, F.concat(F.lit("/Annots/"), i.cast("string")))), lambda p: p.isNotNull())
            rows.append(leaves.where(entry("Annots").startswith("[")).select("file_id", "obj", F.explode(direct).alias("path")))
    if "javascript" in has:
        cut(top, "/Names/JavaScript")
        cut(listed, "/JavaScript")
        cut(every, "/AA")
        for key, of in (("OpenAction", top), ("A", every), ("Next", every)):
            cut(of, f"/{key}", entry(f"{key}.S") == SCRIPT)
            met = link.where(F.col("path") == f"/{key}").join(of.select("file_id", "obj"), ["file_id", "obj"], "left_semi")
            rows.append(met.join(scripts, ["file_id", "dst"], "left_semi").select("file_id", "obj", "path"))
    if "editing" in has:
        cut(every, "/PieceInfo")
        cut(leaves, "/Thumb")
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out.groupBy("file_id", "obj").agg(F.collect_set("path").alias("paths"))


def without_paths(body: Column, paths: Column) -> Column:
    """A dictionary's or array's JSON without what lies at the paths, of one or two steps."""
    gone = lambda at: F.array_contains(paths, at)
    items = lambda v, at: F.filter(v.cast("array<variant>"), lambda x, i: ~gone(F.concat(at, i.cast("string"))))

    def inner(k: Column, v: Column) -> Column:
        at = F.concat(F.lit("/"), k, F.lit("/"))
        kind = F.schema_of_variant(v)
        cut = (
            F.when(kind.startswith("ARRAY"), F.to_json(items(v, at)))
            .when(kind.startswith("OBJECT"), F.to_json(F.map_filter(v.cast("map<string,variant>"), lambda n, _: ~gone(F.concat(at, n)))))
        )
        return F.coalesce(F.when(F.exists(paths, lambda p: p.startswith(at)), F.parse_json(cut)), v)

    cells = F.map_filter(F.from_json(body, "map<string,variant>"), lambda k, v: ~gone(F.concat(F.lit("/"), k)))
    listed = F.to_json(items(F.parse_json(body), F.lit("/")))
    return F.when(body.startswith("["), listed).otherwise(F.to_json(F.transform_values(cells, inner)))


def stripped(found: DataFrame, names: list[str]) -> DataFrame:
    """The objects without the parts in ``names``."""
    if not names:
        return found
    met = found.join(removals(found, names), ["file_id", "obj"], "left")
    under = lambda r: F.exists("paths", lambda p: (r["path"] == p) | r["path"].startswith(F.concat(p, F.lit("/"))))
    changed = F.col("paths").isNotNull()
    body = F.when(changed, without_paths(F.col("body"), F.col("paths"))).otherwise(F.col("body"))
    refs = F.when(changed, F.filter("refs", lambda r: ~under(r))).otherwise(F.col("refs"))
    return met.withColumn("body", body).withColumn("refs", refs).select(*found.columns)


@F.pandas_udf(T.StringType())
def _pointed(body: pd.Series, olds: pd.Series, news: pd.Series, gens: pd.Series) -> pd.Series:
    """Bodies with the numbers of references replaced."""

    def one(text: str, to: dict[int, tuple]) -> str:
        return re.sub(r'\{"ref": ?\[(\d+), ?(\d+)\]\}', lambda m: '{"ref": [%d, %d]}' % to[int(m[1])] if int(m[1]) in to else m[0], text)

    return pd.Series([one(t, dict(zip(o, zip(n, g)))) for t, o, n, g in zip(body, olds, news, gens)])


def merged(found: DataFrame) -> DataFrame:
    """The objects with references to equal streams led to the first of them, again while that makes others equal, ROUNDS times at
    most; the copies go. Streams are equal with the same data and dictionary."""
    for _ in range(ROUNDS):
        node = F.struct("file_id", "obj", "gen")
        streams = found.where("kind = 'stream'").select(node.alias("node"), "file_id", F.col("raw"), F.to_json(F.map_filter(F.from_json("body", "map<string,variant>"), lambda k, v: k != "Length")).alias("rest"))
        pairs = dedup.survivors(streams, "node", [F.col("file_id"), F.hex("raw"), F.col("rest")])
        copies = written(dedup.replacements(pairs, "node").select("old.file_id", F.col("old.obj").alias("dst"), F.col("new.obj").alias("new"), F.col("new.gen").alias("gen")), "copies")
        if copies.isEmpty():
            return found
        moved = links(found).join(copies, ["file_id", "dst"]).groupBy("file_id", "obj").agg(F.collect_set(F.struct("dst", "new", copies["gen"])).alias("to"))
        met = found.join(copies.select("file_id", F.col("dst").alias("obj")), ["file_id", "obj"], "left_anti").join(moved, ["file_id", "obj"], "left")
        hit = lambda r: F.filter("to", lambda t: t["dst"] == r["dst"])
        refs = F.transform("refs", lambda r: F.struct(r["path"].alias("path"), F.coalesce(F.get(hit(r), F.lit(0))["new"], r["dst"]).alias("dst")))
        same = met.where("to is null")
        other = met.where("to is not null").withColumn("body", _pointed("body", F.col("to.dst"), F.col("to.new"), F.col("to.gen"))).withColumn("refs", refs)
        found = written(same.unionByName(other).select(*found.columns), "merged")
    return found


def pruned(found: DataFrame) -> DataFrame:
    """The objects that the trailer's kept entries reach."""
    kept = found.where("obj <> 0").unionByName(found.where("obj = 0").withColumn("refs", F.filter("refs", lambda r: F.split_part(r["path"], F.lit("/"), F.lit(2)).isin(*prune.TRAILER))))
    node = F.struct("file_id", "obj")
    near = graph.reachable(documents.edges(kept).select("src", "dst"), found.where("obj = 0").select(node.alias("node")))
    return found.join(near.select("node.file_id", "node.obj"), ["file_id", "obj"], "left_semi").select(*found.columns)


def recompressible(found: DataFrame) -> Column:
    """Streams that are no images, no parts of the file's own structure, and not the XMP metadata, which stay readable."""
    kind, sub = F.coalesce(entry("Type"), F.lit("")), F.coalesce(entry("Subtype"), F.lit(""))
    return (F.col("kind") == "stream") & (sub != "/Image") & ~kind.isin("/XRef", "/ObjStm", "/Metadata")


def _streams(found: DataFrame, which: Column, change, extra: list[str] | None = None) -> DataFrame:
    """The objects with those of ``which`` replaced by what ``change(raw, filters, body, *extra)`` gives: (raw, filters, body), or None to
    leave one as it is."""
    names = [*found.columns, *(extra or [])]
    same, others = found.where(~which | which.isNull()), found.where(which)
    if extra:
        same = same.drop(*extra)
    schema = others.drop(*(extra or [])).schema
    at = [names.index(c) for c in ("raw", "filters", "body")]
    more = [others.columns.index(c) for c in extra or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, row in enumerate(zip(*columns)):
                new = change(*[row[k] for k in at], *[row[k] for k in more])
                if new is not None:
                    for k, v in zip(at, new):
                        columns[k][i] = v
            keep = [k for k in range(len(columns)) if k not in more]
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], batch.schema.field(k).type) for k in keep], [batch.schema.names[k] for k in keep])

    return same.unionByName(others.mapInArrow(run, schema))


def _deflated(body: str, data: bytes, parms: dict | None = None, **changes) -> tuple[bytes, list[str], str]:
    value = {k: v for k, v in json.loads(body).items() if k not in ("Filter", "DecodeParms", "DL", "Length")}
    value |= {"Filter": "/FlateDecode", **({"DecodeParms": parms} if parms else {}), **changes}
    return zlib.compress(data, 9), ["/FlateDecode"], json.dumps({k: v for k, v in value.items() if v is not None})


def recompressed(found: DataFrame) -> DataFrame:
    """The objects with streams deflated anew where that is smaller. Chains with filters that can't be undone stay."""

    def change(raw: bytes, names: list[str], body: str):
        data = filters.plain(raw, names, json.dumps(json.loads(body).get("DecodeParms")))
        new = None if data is None else _deflated(body, data)
        return new if new and len(new[0]) < len(raw) else None

    return _streams(found, recompressible(found), change)


def grayed(found: DataFrame) -> DataFrame:
    """The objects with device colours of all content turned to gray, each stream by itself: a colour space set in one stream of a
    page does not last into its next. Colour spaces under names of their own stay."""
    own = pages.contents(found, pages.pages(found)).select("file_id", "obj").distinct().withColumn("is_content", F.lit(True))
    met = found.join(own, ["file_id", "obj"], "left").select(*found.columns, "is_content")

    def change(raw: bytes, names: list[str], body: str, _):
        data = filters.plain(raw, names, json.dumps(json.loads(body).get("DecodeParms")))
        new = None if data is None else content.grayed(data)
        return None if new is None or new == data else _deflated(body, new)

    return _streams(met, F.col("is_content"), change, ["is_content"]).select(*found.columns)


def predicted(rows: np.ndarray, step: int) -> bytes:
    """Rows of bytes (two dimensions) with the PNG filter each that has the least sum of absolute values."""
    rows = rows.astype(np.int16)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], up[1:] = rows[:, :-step], rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, step:] = rows[:-1, :-step]
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    all_ = np.stack([rows - p for p in (0 * rows, left, up, (left + up) // 2, paeth)]).astype(np.uint8)
    best = abs(all_.astype(np.int8).astype(np.int32)).sum(axis=2).argmin(axis=0)
    lines = all_[best, np.arange(len(rows))]
    return np.hstack([best[:, None].astype(np.uint8), lines]).tobytes()


def averaged(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """Samples (height, width, parts) as fewer: each is the mean of the area that it covers, rounded half up."""
    for axis, size in ((0, height), (1, width)):
        edges = np.linspace(0, px.shape[axis], size + 1)
        sums = np.concatenate([np.zeros_like(px.take([0], axis), dtype=float), px.cumsum(axis, dtype=float)], axis)
        low = np.minimum(edges.astype(int), px.shape[axis] - 1)
        shape = [-1 if k == axis else 1 for k in range(px.ndim)]
        at = sums.take(low, axis) + (edges - low).reshape(shape) * px.take(low, axis)
        px = np.diff(at, axis=axis) / (px.shape[axis] / size)
    return np.floor(px + 0.5).astype(np.uint8)


def encoded(raw: bytes, names: list[str], body: str, gray: bool, width: int | None, height: int | None) -> tuple | None:
    """The image (raw, filters, body) by its best candidate, None to leave it. Candidates are fewer samples where ``width`` and ``height``
    are given, gray where all colours are or ``gray`` is set, both deflated plain and predicted; a lossy one must save
    a tenth (score 110 for 100). Only images of eight bits in device gray or RGB without keys, masks or decoding."""
    value = json.loads(body)
    parts = {"/DeviceGray": 1, "/DeviceRGB": 3}.get(value.get("ColorSpace") if isinstance(value.get("ColorSpace"), str) else "")
    w, h = value.get("Width"), value.get("Height")
    odd = value.get("BitsPerComponent") != 8 or value.get("ImageMask") or "Decode" in value or "Mask" in value or "Matte" in value
    if parts is None or odd or not (isinstance(w, int) and isinstance(h, int) and 0 < w * h <= images.MOST_SAMPLES):
        return None
    data = filters.plain(raw, names, json.dumps(value.get("DecodeParms")))
    if data is None or len(data) < w * h * parts:
        return None
    px = np.frombuffer(data, np.uint8, w * h * parts).reshape(h, w, parts)
    lossy = False
    if parts == 3 and (gray or bool((px == px[:, :, :1]).all())):
        lossy = not bool((px == px[:, :, :1]).all())
        px = px[:, :, :1] if not lossy else np.floor(px @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)[:, :, None]
    if width and height and width < w and height < h:
        px, lossy = averaged(px, width, height), True
    h, w, parts = px.shape
    sizes = {"Width": w, "Height": h, "ColorSpace": "/DeviceGray" if parts == 1 else value["ColorSpace"]}
    rows = np.ascontiguousarray(px).reshape(h, w * parts)
    tries = [_deflated(body, predicted(rows, parts), {"Predictor": 15, "Colors": parts, "BitsPerComponent": 8, "Columns": w}, **sizes)]
    if rows.size <= images.BOTH:
        tries.insert(0, _deflated(body, rows.tobytes(), **sizes))
    best = min(tries, key=lambda t: len(t[0]))
    wanted = gray and value["ColorSpace"] == "/DeviceRGB"
    return best if wanted or len(best[0]) * (110 if lossy else 100) < len(raw) * 100 else None


def reencoded(found: DataFrame, gray: bool = False, resolution: int | None = None) -> DataFrame:
    """The objects with images encoded anew where that is smaller; with a resolution, images that pages draw at 1.2 times that or more
    get fewer samples."""
    met = found.withColumns({"to_w": F.lit(None).cast("int"), "to_h": F.lit(None).cast("int")})
    if resolution:
        dpi = pages.resolutions(found).select("file_id", F.col("image").alias("obj"), "dpi")
        size = placement.downsampled(entry("Width").try_cast("int"), entry("Height").try_cast("int"), F.col("dpi"), F.lit(resolution))
        met = found.join(dpi, ["file_id", "obj"], "left").withColumn("to", size).select(*found.columns, F.col("to.w").cast("int").alias("to_w"), F.col("to.h").cast("int").alias("to_h"))
    which = (F.col("kind") == "stream") & (F.coalesce(entry("Subtype"), F.lit("")) == "/Image")
    return _streams(met, which, lambda raw, names, body, w, h: encoded(raw, names, body, gray, w, h), ["to_w", "to_h"]).select(*found.columns)


def compressed(files: DataFrame, strip: list[str] | None = None, gray: bool = False, resolution: int | None = None) -> DataFrame:
    """path, content, status, before, after, kept: each of ``files`` (path, content) as small as it becomes. ``kept``: the original stays,
    since nothing smaller came out or (status other than ``ok``) it could not be read."""
    found = written(documents.objects(files), "objects")
    state = found.where("obj = 0").select(F.col("file_id").alias("path"), "status")
    rows = written(stripped(found.where("status = 'ok'"), strip or []), "stripped")
    rows = written(pruned(merged(rows)), "merged")
    rows = written(reencoded(rows, gray, resolution), "images")
    rows = written(recompressed(grayed(rows) if gray else rows), "streams")
    made = documents.files(merged(rows)).select("path", F.col("content").alias("made"))  # copies refer to what stays as well
    size = lambda c: F.octet_length(c).cast("long")
    met = files.select("path", "content").join(state, "path", "left").join(made, "path", "left")
    better = F.coalesce(size("made") < size("content"), F.lit(False))
    out = met.select("path", F.when(better, F.col("made")).otherwise(F.col("content")).alias("content"), F.coalesce("status", F.lit("open")).alias("status"), size("content").alias("before"), (~better).alias("kept"))
    return out.withColumn("after", size("content"))
