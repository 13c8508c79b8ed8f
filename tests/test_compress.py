"""Whole documents: what is stripped, merged, drawn, turned gray and written."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgraph.functions import content, filters
from leafgraph.operators import compress, pages
from leafgraph.sources import documents


def pdf(*objects, trailer="/Root 1 0 R"):
    """A file of (number, dictionary or other value, stream data or None)."""
    out = b"%PDF-1.6\n"
    for number, value, data in objects:
        if data is not None:
            value = value[:-2] + f" /Length {len(data)}>>"
        out += f"{number} 0 obj {value} ".encode() + (b"" if data is None else b"stream\n" + data + b"\nendstream ") + b"endobj\n"
    return out + f"trailer <<{trailer}>>\n%%EOF".encode()


def flat(rng, w, h, parts=3):
    """A picture with large even areas, and its samples."""
    px = np.zeros((h, w, parts), np.uint8)
    for _ in range(6):
        x, y = rng.randrange(w), rng.randrange(h)
        px[y:, x:] = [rng.randrange(256) for _ in range(parts)]
    return px


def loaded(spark, **contents):
    return documents.objects(spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")).cache()


def rich():
    rng = random.Random(5)
    image, again = flat(rng, 60, 40).tobytes(), b"0.5 0 0 0.5 0 0 cm /Im Do"
    js, att = "<</S/JavaScript/JS(x)>>", "[<</Subtype/FileAttachment>> 12 0 R 13 0 R]"
    return pdf(
        (1, f"<</Type/Catalog/Pages 2 0 R/Outlines 9 0 R/PageMode/UseOutlines/Metadata 10 0 R/Names <</JavaScript 11 0 R/EmbeddedFiles 9 0 R/Dests 9 0 R>>/OpenAction 11 0 R/AcroForm {js}>>", None),
        (2, "<</Type/Pages/Kids[3 0 R 20 0 R]/Count 3/Resources<</XObject<</Im 5 0 R/Fm 6 0 R>>>>>>", None),
        (3, f"<</Type/Page/Parent 2 0 R/Contents[4 0 R 8 0 R]/Annots {att}/Thumb 5 0 R/AA {js}/UserUnit 2>>", None),
        (4, "<</X 1>>", b"q 120 0 0 80 0 0 cm"),
        (5, "<</Type/XObject/Subtype/Image/Width 60/Height 40/BitsPerComponent 8/ColorSpace/DeviceRGB>>", image),
        (6, "<</Subtype/Form/Matrix[2 0 0 2 0 0]/PieceInfo <<>>>>", again),
        (7, "<</Subtype/Form/Resources<</XObject 16 0 R>>>>", b"/Im Do /Me Do"),
        (8, "<</X 2>>", b"/Im Do Q 1 0 0 rg 30 0 0 20 0 0 cm /Fm Do 0 1 0 sc"),
        (9, "<</First 9 0 R/Title(t)>>", None),
        (10, "<</Type/Metadata/Subtype/XML>>", b"<x/>" * 50),
        (11, js, None),
        (12, "<</Subtype/FileAttachment/AF 9 0 R>>", None),
        (13, "<</Subtype/Link/A <</S/URI/URI(u)/Next 11 0 R>>/Next 11 0 R>>", None),
        (14, "<</Type/XObject/Subtype/Image/Width 60/Height 40/BitsPerComponent 8/ColorSpace/DeviceRGB>>", image),
        (16, "<</Im 14 0 R/Me 7 0 R>>", None),
        (20, "<</Type/Pages/Kids[21 0 R 22 0 R 3 0 R]/Parent 2 0 R>>", None),
        (21, "<</Type/Page/Parent 20 0 R/Contents 8 0 R/Resources<</XObject<</Fm 14 0 R>>>>>>", None),
        (22, "<</Type/Page/Parent 20 0 R/Contents 23 0 R/Resources 24 0 R>>", None),
        (23, "<<>>", b"/L Do"),
        (24, "<</XObject<</L 7 0 R>>>>", None),
        (30, "<</Never(reached)>>", None),
        trailer="/Root 1 0 R /Info 9 0 R /Junk 30 0 R",
    )


def bodies(found, name="a"):
    return {r.obj: json.loads(r.body) for r in found.where(F.col("file_id") == name).collect()}


def test_pages_contents_and_resources(spark):
    found = loaded(spark, a=rich(), b=pdf((1, "<</Pages 2 0 R>>", None), (2, "<</Kids[2 0 R 3 0 R 2 0 R]>>", None), (3, "<</Type/Page>>", None)), c=b"no")
    leaves = pages.pages(found).cache()
    assert [(r.file_id, r.obj, r.owner) for r in leaves.orderBy("file_id", "ordinal").collect()] == [("a", 3, 2), ("a", 21, 21), ("a", 22, 22), ("b", 3, None)]
    parts = {(r.owner, r.part, r.obj, r.kind) for r in pages.contents(found, leaves).collect()}
    assert parts == {(3, 0, 4, "page"), (3, 1, 8, "page"), (21, 0, 8, "page"), (22, 0, 23, "page"), (6, 0, 6, "form"), (7, 0, 7, "form")}
    assert {(r.owner, r["name"], r.dst) for r in pages.resources(found, "XObject").collect()} == {(2, "Im", 5), (2, "Fm", 6), (21, "Fm", 14), (22, "L", 7), (7, "Im", 14), (7, "Me", 7)}
    # page 3: 240 x 160 points by its unit and, through the form, 60 x 40; page 21 is superseded by the loop over 14
    got = {r.image: r.dpi for r in pages.resolutions(found, leaves).collect()}
    assert got == {5: pytest.approx(60 / (240 / 72)), 14: -1.0}


def test_forms_that_draw_each_other_twice_are_walked_once_a_level(spark):
    twice = [(k, f"<</Subtype/Form/Resources<</XObject<</F {k + 1} 0 R>>>>>>", b"/F Do /F Do") for k in range(10, 22)]
    image = (22, "<</Subtype/Image/Width 72/Height 72>>", b"")
    found = loaded(spark, a=pdf((1, "<</Pages 2 0 R>>", None), (2, "<</Kids[3 0 R]>>", None), (3, "<</Contents 4 0 R/Resources<</XObject<</F 10 0 R>>>>>>", None), (4, "<<>>", b"36 0 0 36 0 0 cm /F Do"), *twice, image))
    assert [(r.image, r.dpi) for r in pages.resolutions(found).collect()] == [(22, 144.0)]


def test_stripping(spark):
    found = loaded(spark, a=rich())
    strip = lambda *names: bodies(compress.stripped(found, list(names)))
    before = bodies(found)
    assert strip() == before
    now = strip("metadata", "bookmarks")
    assert set(now[1]) == set(before[1]) - {"Metadata", "Outlines", "PageMode"} and "Info" not in now[0] and now[3] == before[3]
    now = strip("javascript")
    assert "OpenAction" not in now[1] and set(now[1]["Names"]) == {"EmbeddedFiles", "Dests"} and "AA" not in now[3]
    assert set(now[13]) == {"Subtype", "A"} and now[13]["A"] == before[13]["A"]  # only entries of objects themselves
    now = strip("attachments")
    assert now[3]["Annots"] == [{"ref": [13, 0]}] and set(now[1]["Names"]) == {"JavaScript", "Dests"} and "AF" not in now[12] and "PageMode" in now[1]
    now = strip("annotations", "attachments", "editing")
    assert not {"Annots", "Thumb"} & set(now[3]) and "AcroForm" not in now[1] and "PieceInfo" not in now[6]
    refs = {r.dst for r in compress.stripped(found, ["metadata", "attachments"]).where("obj in (0, 1)").select(F.explode("refs.dst").alias("dst")).collect()}
    assert refs == {1, 2, 9, 11, 30}
    apart = loaded(spark, a=pdf((1, "<</Pages 2 0 R/Names 5 0 R/PageMode/UseAttachments>>", None), (2, "<</Kids[3 0 R]>>", None), (3, "<</Annots 4 0 R>>", None), (4, "[6 0 R 7 0 R]", None), (5, "<</EmbeddedFiles 6 0 R/Dests 7 0 R>>", None), (6, "<</Subtype/FileAttachment>>", None), (7, "<<>>", None)))
    now = bodies(compress.stripped(apart, ["attachments"]))
    assert now[4] == [{"ref": [7, 0]}] and set(now[5]) == {"Dests"} and set(now[1]) == {"Pages", "Names"}


def test_equal_streams_merge_until_none_are_left(spark):
    found = loaded(spark, a=pdf((1, "<</Pages 2 0 R/A 5 0 R/B 6 0 R/C [7 0 R]>>", None), (2, "<</Kids[]>>", None), (3, "<</K 1>>", b"same"), (4, "<</K 1>>", b"same"), (5, "<</R 3 0 R>>", b"x"), (6, "<</R 4 0 R>>", b"x"), (7, "<</R 4 0 R>>", b"y")))
    now = bodies(compress.merged(found))
    assert set(now) == {0, 1, 2, 3, 5, 7} and now[1] == {"Pages": {"ref": [2, 0]}, "A": {"ref": [5, 0]}, "B": {"ref": [5, 0]}, "C": [{"ref": [7, 0]}]} and now[7]["R"] == {"ref": [3, 0]}


def image_of(found, name, obj):
    row = found.where((F.col("file_id") == name) & (F.col("obj") == obj)).first()
    value = json.loads(row.body)
    data = filters.plain(bytes(row.raw), row.filters, json.dumps(value.get("DecodeParms")))
    return value, np.frombuffer(data, np.uint8).reshape(value["Height"], value["Width"], -1)


def test_documents_become_smaller_and_say_the_same(spark):
    files = spark.createDataFrame([("a", bytearray(rich())), ("b", bytearray(b"not one")), ("c", bytearray(rich().replace(b"/Junk", b"/Encrypt"))), ("d", None)], "path string, content binary")
    out = {r.path: r for r in compress.compressed(files, ["metadata", "bookmarks"]).collect()}
    assert {k: (r.status, r.kept) for k, r in out.items()} == {"a": ("ok", False), "b": ("open", True), "c": ("password_required", True), "d": ("open", True)}
    assert out["a"].after == len(out["a"].content) < out["a"].before / 3 and bytes(out["b"].content) == b"not one"
    assert not any(w in bytes(out["a"].content) for w in (b"Outlines", b"/Info ", b"Never", b"Metadata"))
    before, after = loaded(spark, a=rich()), loaded(spark, a=bytes(out["a"].content))
    assert np.array_equal(image_of(after, "a", 5)[1], image_of(before, "a", 5)[1])
    assert after.where("obj in (10, 14, 30)").count() == 0  # metadata, the merged copy, what nothing reaches
    texts = {r.obj: filters.plain(bytes(r.raw), r.filters) for r in after.where("obj in (4, 8, 23)").collect()}
    assert texts == {r.obj: bytes(r.raw) for r in before.where("obj in (4, 8, 23)").collect()}
    assert [r.obj for r in pages.pages(after).orderBy("ordinal").collect()] == [3, 21, 22]


def test_documents_in_gray_and_with_fewer_samples(spark):
    page = lambda at, im: pdf((1, "<</Pages 2 0 R>>", None), (2, "<</Kids[3 0 R]>>", None), (3, "<</Contents 4 0 R/Resources<</XObject<</I 5 0 R>>>>>>", None), (4, "<<>>", at), (5, "<</Subtype/Image/Width 60/Height 40/BitsPerComponent 8/ColorSpace/DeviceRGB>>", im))
    px = flat(random.Random(2), 60, 40)
    neutral = np.repeat(px[:, :, :1], 3, axis=2)
    files = spark.createDataFrame([("a", bytearray(page(b"0 1 0 rg 0 0 9 9 re f 1 0 0 sc 30 0 0 20 0 0 cm /I Do", px.tobytes()))), ("n", bytearray(page(b"/I Do", neutral.tobytes())))], "path string, content binary")
    out = {r.path: bytes(r.content) for r in compress.compressed(files, gray=True, resolution=72).collect()}
    found = loaded(spark, **out)
    value, small = image_of(found, "a", 5)
    assert (value["Width"], value["Height"], value["ColorSpace"], small.shape) == (30, 20, "/DeviceGray", (20, 30, 1))
    gray = np.floor(px @ np.array([0.299, 0.587, 0.114]) + 0.5)
    assert np.array_equal(small[:, :, 0], np.floor(gray.reshape(20, 2, 30, 2).mean(axis=(1, 3)) + 0.5))
    text = found.where("file_id = 'a' and obj = 4").first()
    assert filters.plain(bytes(text.raw), text.filters) == b"0.587 g 0 0 9 9 re f 0.299 sc 30 0 0 20 0 0 cm /I Do"
    value, same = image_of(found, "n", 5)  # drawn in one point, at 2880 dpi
    assert value["ColorSpace"] == "/DeviceGray" and same.shape == (1, 2, 1)


def test_images_keep_their_samples_without_options(spark):
    neutral = np.repeat(flat(random.Random(2), 60, 40)[:, :, :1], 3, axis=2)
    image = "<</Subtype/Image/Width 60/Height 40/BitsPerComponent 8/ColorSpace/DeviceRGB"
    found = loaded(spark, n=pdf((5, image + ">>", neutral.tobytes()), (6, image + "/Mask[1 2]>>", neutral.tobytes())))
    made = compress.reencoded(found).cache()
    value, same = image_of(made, "n", 5)
    assert value["ColorSpace"] == "/DeviceGray" and np.array_equal(same[:, :, 0], neutral[:, :, 0])
    assert image_of(made, "n", 6)[0] == image_of(found, "n", 6)[0]


def test_prediction_undoes(spark):
    rng = np.random.default_rng(1)
    for h, w, parts in ((1, 1, 1), (7, 5, 3), (4, 9, 1)):
        px = rng.integers(0, 256, (h, w * parts)).astype(np.uint8)
        parms = {"Predictor": 15, "Colors": parts, "Columns": w}
        assert filters.unpredicted(compress.predicted(px, parts), parms) == px.tobytes()
    assert compress.averaged(np.array([[[0], [90], [30]]], np.uint8), 2, 1).ravel().tolist() == [30, 50]


def test_colours_after_device_operators():
    for before, after in {
        b"1 0 0 rg 0 1 0 sc": b"0.299 g 0.587 sc",
        b"0 0 0 1 K 1 g 0 0 0 0.5 SC 0 1 0 sc": b"0 G 1 g 0.5 SC 0 1 0 sc",
        b"/P cs 0 0 1 /Pat scn 0 0 1 scn": b"/P cs 0.114 /Pat scn 0 0 1 scn",
    }.items():
        assert content.grayed(before, {b"/P": "pattern rgb"}) == after
    assert list(content.draws(b"q 2 0 0 2 0 0 cm /A Do Q Q /B Do")) == [("A", (2, 0, 0, 2, 0, 0)), ("B", content.ONE)]
