"""Filters, JPEG headers, page content, image rules and reports."""

import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from leafgraph.functions import codecs, content, filters
from leafgraph.operators import images, report


def lzw_encoded(data):
    table, width, bits, last = {bytes([i]): i for i in range(256)}, 9, "", b""
    put = lambda code: f"{code:0{width}b}"
    bits, size = put(256), 258
    for b in data:
        word = last + bytes([b])
        if word in table:
            last = word
            continue
        bits += put(table[last])
        table[word] = size
        size += 1
        width = min(12, max(9, size.bit_length()))
        last = bytes([b])
        if size == 4094:
            bits += put(table[last]) + put(256)
            table, width, size, last = {bytes([i]): i for i in range(256)}, 9, 258, b""
    bits += put(table[last]) if last else ""
    size += 1
    width = min(12, max(9, size.bit_length()))
    bits += put(257)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_filter_chains():
    data = bytes(range(256)) * 9 + b"aaaaabaaaa" * 50
    predicted = zlib.compress(codecs.png_predict(data[: 12 * 230], 12, 3))
    assert filters.decoded(predicted, ["/FlateDecode"], {"Predictor": 15, "Colors": 3, "Columns": 4}) == (data[: 12 * 230], [])
    chain = base64.a85encode(zlib.compress(data)) + b"~>"
    assert filters.decoded(chain, ["/A85", "/FlateDecode"], [None, {}]) == (data, [])
    assert filters.decoded(b"\xff\xd8".hex().encode() + b" >", ["/ASCIIHexDecode", "/DCTDecode"]) == (b"\xff\xd8", ["/DCTDecode"])
    assert filters.decoded(b"\x02abc\xfez\x80junk", ["/RunLengthDecode"]) == (b"abczzz", [])
    assert filters.lzw(bytes.fromhex("800b6050220c0c8501")) == b"-----A---B"
    assert filters.lzw(lzw_encoded(data)) == data
    assert filters.unpredicted(bytes([1, 2, 1, 1, 5, 5]), {"Predictor": 2, "Columns": 3}) == bytes([1, 3, 4, 1, 6, 11])


def test_jpeg_headers():
    adobe = b"\xff\xee" + struct.pack(">H", 14) + b"Adobe" + bytes(6) + b"\x02"
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 600, 800, 3) + bytes(9)
    assert filters.jpeg_header(b"\xff\xd8" + adobe + frame) == {"width": 800, "height": 600, "parts": 3, "precision": 8, "progressive": True, "adobe": 2}
    assert filters.jpeg_header(b"GIF89a") is None and filters.jpeg_header(b"\xff\xd8\xff") is None


def test_placements_and_resolution():
    text = b"Q q 400 0 0 300 0 50 cm /Im Do Q 1 2 cm 10 0 0 10 0 0 cm /Fm Do % /Im Do\n(/Im Do) Tj"
    found = list(content.draws(text))
    assert found == [("Im", (400, 0, 0, 300, 0, 50)), ("Fm", (10.0, 0, 0, 10.0, 0, 0))]
    assert content.dpi(800, 600, found[0][1]) == pytest.approx(144) and content.dpi(1, 1, (0,) * 6) is None


def test_gray_content():
    for before, after in {
        b"q 1 0 0 rg 0 0 1 RG Q": b"q 0.299 g 0.114 G Q",
        b"/DeviceRGB cs 1 1 0 sc 0 0 1 1 k": b"/DeviceGray cs 0.886 sc 0 g",
        b"/P1 cs /Pat scn 1 0 rg": b"/P1 cs /Pat scn 1 0 rg",
        b"q /DeviceCMYK CS Q 0 0 0 0 SCN 0.5 g": b"q /DeviceGray CS Q 0 0 0 0 SCN 0.5 g",
        b"(1 0 0 rg) Tj %1 0 0 rg\n1 0 0 rg": b"(1 0 0 rg) Tj %1 0 0 rg\n0.299 g",
    }.items():
        assert content.grayed(before) == after
    assert b"".join(t for _, t in content.tokens(b"a <</B [1 .5]>> (\\() <41> %c")) == b"a <</B [1 .5]>> (\\() <41> %c"


def test_image_rules(spark):
    rows = [
        (1, 10, 10, 8, ["/FlateDecode"], False, False, None, None, 100, 10),
        (2, 10, 10, 8, ["/FlateDecode"], False, False, None, None, 99, 10),
        (3, 10, 10, 8, ["/DCTDecode"], False, False, None, (10, 10, 8), 5, 10),
        (4, 10, 10, 8, ["/DCTDecode"], False, False, None, (10, 11, 8), 5, 10),
        (5, 10, 10, 3, [], False, False, None, None, 100, 10),
        (6, 0, 10, 8, [], False, False, None, None, 100, 10),
        (7, 10, 10, 8, ["/DCTDecode", "/FlateDecode"], False, False, None, None, 100, 10),
        (8, 30000, 30000, 8, [], False, False, None, None, 100, 10),
    ]
    names = "id int, width int, height int, bits int, filters array<string>, is_mask boolean, indexed boolean, color_transform int, jpeg struct<width:int,height:int,precision:int>, data_bytes long, row_bytes long"
    df = spark.createDataFrame(rows, names)
    cells = {c: F.col(c) for c in [*df.columns, "jpeg.width", "jpeg.height", "jpeg.precision"]}
    got = {r.id: r.why for r in df.select("id", images.reject_reason(cells).alias("why")).collect()}
    assert got == {1: None, 2: "truncated", 3: None, 4: "JPEG header", 5: "depth", 6: "empty", 7: "codec order", 8: "too large"}
    tried = images.tries(df.where("id in (1, 5)"), "id", images.flate_tries(F.when(F.col("id") == 1, 8).otherwise(1), F.lit(100), F.lit(False)))
    assert sorted((r.id, r.ordinal, r.label) for r in tried.collect()) == [(1, 0, "flate"), (5, 0, "flate"), (5, 1, "flate predicted"), (5, 2, "g4"), (5, 3, "jbig2")]
    space = df.limit(1).select(images.color_space(F.lit("/ICCBased"), F.lit(3)).alias("a"), images.color_space(F.lit("/DeviceN"), F.lit(40)).alias("b")).first()
    assert tuple(space.a) == ("RGB", 3) and space.b is None
    gray = df.limit(1).select(images.to_gray(F.lit(True), F.lit("RGB"), F.lit("Near"), F.lit(False), F.lit(False)).alias("a"), images.to_gray(F.lit(True), F.lit("CMYK"), F.lit("Color"), F.lit(False), F.lit(True)).alias("b")).first()
    assert (gray.a, gray.b) == (False, True)


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1000, 400, False, None), ("b", 50, 50, True, None), ("c", 10, 0, False, "can't be opened")], "name string, before long, after long, kept boolean, error string")
    assert [r.line for r in report.lines(rows).orderBy("name").collect()] == ["a: 1 KB → 400 bytes (−60%)", "b: already small", "c: can't be opened"]
    t = report.totals(rows).first()
    assert (t.files, t.before, t.after, t.percent, t.failed, t.status) == (2, 1050, 450, 57, 1, 1)
    assert report.totals(rows.limit(0)).first().percent is None
