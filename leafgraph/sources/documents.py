"""PDF files as tables of objects and references, and back.

A value is JSON: names begin with ``/``, strings with ``s:`` (Latin-1), references are ``{"ref": [number, generation]}``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "file_id string, obj int, gen int, kind string, body string, raw binary, filters array<string>, "
    "refs array<struct<path:string,dst:int>>, status string"
)
DEPTH = 64
_BLANK = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,9})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![a-z])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Reader:
    """Values of PDF syntax at a place in bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def blank(self) -> None:
        self.at = _BLANK.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        self.blank()
        if depth > DEPTH:
            raise ValueError("values are nested too deeply")
        start = self.data[self.at : self.at + 2]
        if start == b"<<":
            return self._entries(depth)
        if start[:1] == b"[":
            self.at += 1
            return list(self._until(b"]", depth))
        if start[:1] == b"/":
            return self._name()
        if start[:1] == b"(":
            return "s:" + self._string()
        if start[:1] == b"<":
            end = self.data.index(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
            self.at = end + 1
            return "s:" + bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
        if m := _REF.match(self.data, self.at):
            self.at = m.end()
            return {"ref": [int(m[1]), int(m[2])]}
        m = _WORD.match(self.data, self.at)
        if not m:
            raise ValueError(f"no value at {self.at}")
        self.at = m.end()
        word = m[0].decode("latin-1")
        if word in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[word]
        return float(word) if "." in word else int(word)

    def _until(self, end: bytes, depth: int) -> Iterator:
        while True:
            self.blank()
            if self.data.startswith(end, self.at):
                self.at += len(end)
                return
            if self.at >= len(self.data):
                raise ValueError("the data ends in a value")
            yield self.value(depth + 1)

    def _entries(self, depth: int) -> dict:
        self.at += 2
        items = list(self._until(b">>", depth))
        return {k[1:]: v for k, v in zip(items[::2], items[1::2]) if v is not None}

    def _name(self) -> str:
        m = _WORD.match(self.data, self.at + 1)
        self.at = m.end() if m else self.at + 1
        return "/" + re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[0].decode("latin-1") if m else "")

    def _string(self) -> str:
        out, open_, self.at = bytearray(), 1, self.at + 1
        while open_:
            c = self.data[self.at : self.at + 1]
            if not c:
                raise ValueError("the data ends in a string")
            self.at += 1
            if c == b"\\":
                if m := re.compile(rb"[0-7]{1,3}").match(self.data, self.at):
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                    continue
                c = self.data[self.at : self.at + 1]
                self.at += 1
                out += b"" if c in (b"\n", b"\r") else _ESCAPES.get(c, c)
                continue
            open_ += (c == b"(") - (c == b")")
            out += c if open_ else b""
        return out.decode("latin-1")


def filter_names(filters) -> list[str]:
    """The names of a filter chain: nothing, a name, or an array of names."""
    return [x for x in (filters if isinstance(filters, list) else [filters]) if isinstance(x, str)]


def references(value, path: str = "") -> Iterator[tuple[str, int]]:
    """(path, object number) of the references directly inside a value."""
    if isinstance(value, dict):
        if set(value) == {"ref"}:
            yield path, value["ref"][0]
            return
        for k, v in value.items():
            yield from references(v, f"{path}/{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from references(v, f"{path}/{i}")


def parsed(data: bytes) -> tuple[dict[int, tuple], dict]:
    """Objects by number (generation, value, raw stream or None), the last definition of each, and the trailer."""
    found: dict[int, tuple] = {}
    trailer: dict = {}
    at = 0
    while m := _OBJECT.search(data, at):
        reader = Reader(data, m.end())
        try:
            value = reader.value()
        except (ValueError, RecursionError, TypeError):
            at = m.end()
            continue
        at, raw = reader.at, None
        reader.blank()
        if isinstance(value, dict) and data.startswith(b"stream", reader.at):
            start = reader.at + 6
            start += 2 if data.startswith(b"\r\n", start) else 1
            length = value.get("Length")
            if not isinstance(length, int) or not re.match(rb"\s*endstream", data[start + length : start + length + 20]):
                end = data.find(b"endstream", start)
                end = len(data) if end < 0 else end
                length = len(data[start:end].rstrip(b"\r\n"))
            raw, at = data[start : start + length], start + length
        if isinstance(value, dict) and value.get("Type") == "/XRef":
            trailer = value | trailer
        found[int(m[1])] = (int(m[2]), value, raw)
    for m in re.finditer(rb"trailer", data):
        try:
            value = Reader(data, m.end()).value()
        except (ValueError, TypeError):
            continue
        trailer |= value if isinstance(value, dict) else {}
    for _, value, raw in list(found.values()):
        if isinstance(value, dict) and value.get("Type") == "/ObjStm" and raw is not None:
            body = zlib.decompress(raw) if filter_names(value.get("Filter")) == ["/FlateDecode"] else raw
            head = Reader(body)
            numbers = [head.value() for _ in range(2 * value["N"])]
            for number, place in zip(numbers[::2], numbers[1::2]):
                found.setdefault(number, (0, Reader(body, value["First"] + place).value(), None))
    return found, trailer


def kind_of(value, raw: bytes | None) -> str:
    if raw is not None:
        return "stream"
    return {dict: "dictionary", list: "array"}.get(type(value), "scalar")


def rows_of(file_id: str, data: bytes) -> list[tuple]:
    """Rows of SCHEMA; the trailer is object 0. A file that can't be read is one row with its status."""
    if b"%PDF-" not in data[:1024]:
        return [(file_id, 0, 0, "trailer", None, None, [], [], "open")]
    try:
        found, trailer = parsed(data)
    except (ValueError, KeyError, zlib.error) as error:
        return [(file_id, 0, 0, "trailer", json.dumps(str(error)), None, [], [], "open")]
    if "Encrypt" in trailer:
        return [(file_id, 0, 0, "trailer", json.dumps(trailer), None, [], [], "password_required")]
    out = [(file_id, 0, 0, "trailer", json.dumps(trailer), None, [], list(references(trailer)), "ok")]
    for number, (gen, value, raw) in sorted(found.items()):
        filters = filter_names(value.get("Filter")) if raw is not None else []
        out.append((file_id, number, gen, kind_of(value, raw), json.dumps(value), raw, filters, list(references(value)), "ok"))
    return out


def objects(files: DataFrame) -> DataFrame:
    """The objects of ``files`` (path, content), columns as in SCHEMA. A broken file never fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = rows_of(path.as_py(), content.as_py() or b"")
                for start in range(0, len(rows), 1000):
                    columns = list(zip(*rows[start : start + 1000]))
                    columns[7] = [[{"path": p, "dst": d} for p, d in refs] for refs in columns[7]]
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.struct([("path", pa.string()), ("dst", pa.int32())])), pa.string()]
                    names = ["file_id", "obj", "gen", "kind", "body", "raw", "filters", "refs", "status"]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def edges(found: DataFrame) -> DataFrame:
    """src, dst: references between objects, each a struct of file_id and obj."""
    rows = found.select("file_id", "obj", F.explode("refs").alias("r"))
    node = lambda key: F.struct("file_id", F.col(key).cast("int").alias("obj"))
    return rows.select(node("obj").alias("src"), node("r.dst").alias("dst"), F.col("r.path").alias("path"))


def written_value(value) -> str:
    """PDF syntax of a value."""
    if isinstance(value, dict):
        if set(value) == {"ref"}:
            return "{} {} R".format(*value["ref"])
        return "<<" + "".join(f"/{_escaped(k)} {written_value(v)} " for k, v in value.items()) + ">>"
    if isinstance(value, list):
        return "[" + " ".join(map(written_value, value)) + "]"
    if isinstance(value, str):
        return "/" + _escaped(value[1:]) if value.startswith("/") else "<" + value[2:].encode("latin-1").hex() + ">"
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return f"{value:.10f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def _escaped(name: str) -> str:
    return "".join(c if c.isalnum() or c in "-_.+" else f"#{ord(c):02x}" for c in name)


def file_of(rows: list[tuple[int, int, str, bytes | None]]) -> bytes:
    """A file of (obj, gen, body, raw); object 0 is the trailer. Streams that carried other objects or the old table of
    places are left out: their objects are rows of their own."""
    out, places = bytearray(b"%PDF-1.7\n"), {}
    trailer: dict = {}
    for obj, gen, body, raw in sorted(rows, key=lambda r: r[0]):
        value = json.loads(body)
        if obj == 0:
            trailer = {k: v for k, v in value.items() if k in ("Root", "Info", "ID")}
            continue
        if isinstance(value, dict) and value.get("Type") in ("/ObjStm", "/XRef"):
            continue
        places[obj] = (len(out), gen)
        if raw is not None:
            value = value | {"Length": len(raw)}
        out += f"{obj} {gen} obj\n{written_value(value)}\n".encode("latin-1")
        if raw is not None:
            out += b"stream\n" + raw + b"\nendstream\n"
        out += b"endobj\n"
    size, start = max(places, default=0) + 1, len(out)
    out += f"xref\n0 {size}\n".encode() + b"0000000000 65535 f \n"
    for obj in range(1, size):
        at, gen = places.get(obj, (0, 65535))
        out += f"{at:010d} {gen:05d} {'n' if obj in places else 'f'} \n".encode()
    out += b"trailer\n" + written_value(trailer | {"Size": size}).encode("latin-1") + f"\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def files(found: DataFrame) -> DataFrame:
    """path, content: one file of the objects of each file_id. A file's objects meet in one task, as its bytes must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(name: str, rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([file_of(rows)], pa.binary())], ["path", "content"])

        held, key = [], None
        for batch in batches:
            for file_id, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and file_id != key:
                    yield pack(key, held)
                    held = []
                key = file_id
                held.append(tuple(row))
        if held:
            yield pack(key, held)

    rows = found.where("status = 'ok'").select("file_id", "obj", "gen", "body", "raw")
    return rows.repartition("file_id").sortWithinPartitions("file_id", "obj").mapInArrow(run, "path string, content binary")
