"""Round trips of the codecs, and known bytes."""

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from leafgraph import plans
from leafgraph.functions import codecs

DIR = "/root/testdata/sf0.001"


def images():
    rng = random.Random(4)
    for width in (1, 7, 8, 31, 64, 200, 3000, 6000):
        for share in (0.0, 0.02, 0.5, 1.0):
            rows = [[int(rng.random() < share) for _ in range(width)] for _ in range(3)]
            yield width, [*rows, rows[-1], [v ^ (i % 97 == 0) for i, v in enumerate(rows[0])]]


def test_run_codes_are_prefix_free():
    for codes in (codecs.WHITE + codecs.LONG, codecs.BLACK + codecs.LONG):
        assert len(codes) == 64 + 27 + 13 == len(set(codes))
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_g4_and_jbig2_round_trips():
    for width, rows in images():
        assert codecs.g4_decode(codecs.g4_encode(rows, width), width, len(rows)) == rows
        if width <= 200:
            assert codecs.jbig2_decode(codecs.jbig2_encode(rows, width)) == rows


def test_g4_of_white_rows_is_one_bit_a_row():
    assert codecs.g4_encode([[0] * 100] * 8, 100) == bytes.fromhex("ff001001")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.randoms(use_true_random=False))
def test_random_round_trips(width, height, rng):
    rows = [[rng.randrange(2) for _ in range(width)] for _ in range(height)]
    assert codecs.g4_decode(codecs.g4_encode(rows, width), width, height) == rows
    assert codecs.jbig2_decode(codecs.jbig2_encode(rows, width)) == rows
    data = bytes(rng.randrange(256) for _ in range(width * height))
    assert codecs.png_restore(codecs.png_predict(data, width), width) == data
    assert zlib.decompress(codecs.deflate(data)) == data


def test_plans_of_codecs(spark):
    q = plans.queries()
    assert q["q58_g4_roundtrip"](spark, DIR).where("not same").count() == 0
    assert q["q59_jbig2_size"](spark, DIR).where("not same").count() == 0
    sizes = {r.doc_id: r.after for r in q["q56_flate_sizes"](spark, DIR).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert sizes == {i: len(zlib.compress(t.encode(), 9)) for i, t in texts.items()}
    assert q["q57_png_flate"](spark, DIR).count() == spark.read.parquet(f"{DIR}/embeddings.parquet").count()
