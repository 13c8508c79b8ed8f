"""Files, objects and references of hand-made documents."""

import json
import zlib

from pyspark.sql import functions as F

from leafgraph.operators import graph
from leafgraph.sources import documents, files


def pdf(extra=b"", info=b"", stream=b"0 0 1 rg 0 0 9 9 re f"):
    parts = [
        b"1 0 obj <</Type/Catalog/Pages 2 0 R" + extra + b">> endobj\n",
        b"2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n",
        b"3 0 obj <</Type/Page /Parent 2 0 R /Contents 4 0 R /MediaBox [0 0 1.5 9] /Na#6de (a\\(b\\051\\\n) >> endobj\n",
        b"4 0 obj <</Length %d>> stream\n%s\nendstream endobj\n" % (len(stream), stream),
        b"5 0 obj <</Lost true /Peer 6 0 R>> endobj 6 0 obj [5 0 R null <61>] endobj\n",
    ]
    return b"%PDF-1.4\n" + b"".join(parts) + b"trailer <</Root 1 0 R /Size 7" + info + b">>\n%%EOF"


def packed():
    """Objects 2 and 3 lie in an object stream."""
    a, b = b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R>>"
    body = b"2 0 3 %d " % len(a)
    data = zlib.compress(body + a + b)
    head = b"%%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n7 0 obj <</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>> stream\r\n" % (len(body), len(data))
    return head + data + b"\nendstream endobj\n8 0 obj <</Type/XRef/Root 1 0 R/Size 9/Length 0>> stream\n\nendstream endobj"


def loaded(spark, **contents):
    return documents.objects(spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary"))


def test_objects_and_what_is_reachable(spark):
    found = loaded(spark, a=pdf(), b=packed(), c=b"nothing", d=pdf(info=b" /Encrypt 9 0 R"), e=b"%PDF-1.4 1 0 obj <<", f=b"").cache()
    status = {r.file_id: r.status for r in found.where("obj = 0").collect()}
    assert status == {"a": "ok", "b": "ok", "c": "open", "d": "password_required", "e": "ok", "f": "open"}
    roots = found.where("obj = 0").select(F.struct("file_id", "obj").alias("node"))
    reach = graph.reachable(documents.edges(found).select("src", "dst"), roots)
    assert {(r.node.file_id, r.node.obj) for r in reach.where("depth > 0").collect()} == {("a", i) for i in (1, 2, 3, 4)} | {("b", i) for i in (1, 2, 3)}
    page = json.loads(found.where("file_id = 'a' and obj = 3").first().body)
    assert page["Name"] == "s:a(b)" and page["MediaBox"] == [0, 0, 1.5, 9] and page["Contents"] == {"ref": [4, 0]}
    assert bytes(found.where("file_id = 'a' and obj = 4").first().raw) == b"0 0 1 rg 0 0 9 9 re f"


def test_files_of_objects_read_back(spark):
    found = loaded(spark, a=pdf(), b=packed()).where("obj not in (5, 6)")
    again = documents.objects(documents.files(found)).cache()
    rows = lambda df: sorted((r.file_id, r.obj, r.body.replace('"Length": 21', "") if r.obj == 4 else r.body) for r in df.where("obj > 0 and obj < 7").collect())
    assert rows(again) == rows(found)
    assert b"startxref" in bytes(documents.files(found).first().content)


def test_discovery(spark, tmp_path):
    for name in ("x/f10.pdf", "x/f2.PDF", "x/note.txt", "x/.hidden/h.pdf", "one.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(pdf())
    got = files.discovered(spark, [str(tmp_path / "one.pdf"), str(tmp_path), str(tmp_path / "missing")]).orderBy("arg", "key").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["one.pdf", "f2.PDF", "f10.pdf"]
    assert all(r.length == len(pdf()) for r in got)
    assert files.discovered(spark, ["/does/not/exist"]).count() == 0
    read = files.discovered(spark, [str(tmp_path)], content=True)
    assert documents.objects(read).where("kind = 'stream'").count() == 3


def test_hidden_folders_above_the_given_one_hide_nothing(spark, tmp_path):
    base = tmp_path / ".mnt" / "in"
    for name in ("a.pdf", "b.PDF", ".c.pdf", ".d/e.pdf", "f/g.pdf", "h.txt"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(b"x")
    got = files.discovered(spark, [str(base), str(base / "f"), str(base / "none")]).collect()
    assert sorted((r.path.split("/in/")[1], r.arg) for r in got) == [("a.pdf", 0), ("b.PDF", 0), ("f/g.pdf", 0)]
