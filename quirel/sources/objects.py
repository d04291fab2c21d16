"""PDF bytes to tables of objects.

A file is parsed by a small helper inside Arrow batches; what leaves it are flat rows: cross-reference entries,
and objects as tagged JSON for VARIANT columns. Following references, walking trees and
everything else is left to joins over those tables.

Tags: {"n": name}, {"s": hex bytes}, {"r": [number, generation]}; other values stand for themselves.
"""

from __future__ import annotations

import json
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions.codecs import FilterError, decode_chain

#: Nesting of an object, hops between revisions, bytes searched for startxref.
DEPTH, HOPS, TAIL = 256, 32, 4096
#: Fixed value: references that an object may lead through.
CHASE = 16

_SPACE = rb"\x00\t\n\x0c\r "
_TOKEN = re.compile(
    rb"(?:[" + _SPACE + rb"]|%[^\r\n]*)*(?:(?P<ref>\d+\s+\d+\s+R(?![A-Za-z0-9]))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|/(?P<name>[^" + _SPACE + rb"()<>\[\]{}/%]*)|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[^>]*)>|(?P<lit>\()|(?P<word>[A-Za-z'\"*]+[0-9]*\*?))"
)
_XREF = re.compile(rb"\s*xref\s*")
_HEAD = re.compile(rb"(\d+)[ \t]+(\d+)\s*")
_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])\s*")
_TRAILER = re.compile(rb"\s*trailer")
_OBJ = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj")
_STREAM = re.compile(rb"\s*stream(\r\n|\n|\r)")
_ENDSTREAM = re.compile(rb"\s*endstream")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_LITERAL = re.compile(rb"[()\\\r]")


class PdfError(ValueError):
    """Bytes that aren't a readable file or object."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins behind an opening bracket, and the place behind it."""
    out, depth = bytearray(), 1
    while True:
        m = _LITERAL.search(data, at)
        if not m:
            raise PdfError("string without end")
        out += data[at : m.start()]
        at, c = m.end(), m[0]
        if c == b"(":
            depth += 1
            out += c
        elif c == b")":
            depth -= 1
            if not depth:
                return bytes(out), at
            out += c
        elif c == b"\r":
            out += b"\n"
            at += data[at : at + 1] == b"\n"
        else:
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            e = data[at : at + 1]
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += octal.end()
            elif e in b"\r\n":
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            else:
                out += _ESCAPES.get(e, e)
                at += 1


def _name(raw: bytes) -> str:
    if b"#" in raw:
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse(data: bytes, at: int = 0, depth: int = 0):
    """One object and the place behind it; a word that is no object comes back as bytes."""
    if depth > DEPTH:
        raise PdfError("nested too deep")
    m = _TOKEN.match(data, at)
    if not m:
        raise PdfError("no object")
    at, kind = m.end(), m.lastgroup
    text = m[kind]
    if kind == "num":
        return (float(text) if b"." in text else int(text)), at
    if kind == "ref":
        number, generation, _ = text.split()
        return {"r": [int(number), int(generation)]}, at
    if kind == "name":
        return {"n": _name(text)}, at
    if kind == "hex":
        digits = b"".join(text.split())
        return {"s": (digits + b"0" * (len(digits) % 2)).decode("ascii", "replace").lower(), "h": True}, at
    if kind == "lit":
        s, at = literal(data, at)
        return {"s": s.hex()}, at
    if kind == "word":
        return {b"true": True, b"false": False, b"null": None}.get(text, text), at
    if kind == "close":
        raise PdfError("closed without being open")
    items = []
    end = b">>" if text == b"<<" else b"]"
    while True:
        m = _TOKEN.match(data, at)
        if not m:
            raise PdfError("open without end")
        if m["close"]:
            if m["close"] != end:
                raise PdfError("closed by another mark")
            at = m.end()
            break
        value, at = parse(data, at, depth + 1)
        items.append(value)
    if end == b"]":
        return items, at
    return {k["n"]: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, dict) and "n" in k}, at


#: Bytes up to which objects are remembered, and how many of them a worker remembers.
REPEATED_BYTES, REPEATED = 16_384, 2048


@lru_cache(maxsize=REPEATED)
def _repeated(body: bytes):
    """(object,) of the bytes before an endobj, such as a font that many files share; null where they aren't just an object, or not all of it."""
    try:
        value, end = parse(body)
    except PdfError:
        return None
    return None if body[end:].strip(b"\x00\t\n\x0c\r ") else (value,)


def plain(value):
    """Numbers, names and lists of them without their tags, for parameters."""
    if isinstance(value, dict):
        return value["n"] if "n" in value else {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def as_list(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


class File:
    """A file's cross-reference entries by revision, and its objects on demand."""

    def __init__(self, data: bytes):
        self.data, self.rows, self.trailer = data, [], {}
        tail = data[-TAIL:].rfind(b"startxref")
        m = re.match(rb"startxref\s+(\d+)", data[max(0, len(data) - TAIL) + tail :]) if tail >= 0 else None
        if not m:
            raise PdfError("no startxref")
        at, seen, rev = int(m[1]), set(), 0
        while at is not None:
            if at in seen or len(seen) >= HOPS:
                raise PdfError("revisions in a circle")
            seen.add(at)
            trailer = self._section(at, rev)
            self.trailer = {**trailer, **self.trailer}
            at, rev = trailer.get("Prev"), rev + 1
        self.at = {}
        for _, _, number, kind, a, b in sorted(self.rows, key=lambda r: r[:2]):
            self.at.setdefault(number, (kind, a, b))
        self.packs: dict[int, dict[int, int]] = {}

    def _section(self, at: int, rev: int) -> dict:
        m = _XREF.match(self.data, at)
        if not m:
            return self._stream_section(at, rev, 2)
        at = m.end()
        while h := _HEAD.match(self.data, at):
            at = h.end()
            for i in range(int(h[2])):
                e = _ENTRY.match(self.data, at)
                if not e:
                    raise PdfError("cross-reference entry")
                at = e.end()
                self.rows.append((rev, 0, int(h[1]) + i, "used" if e[3] == b"n" else "free", int(e[1]), int(e[2])))
        t = _TRAILER.match(self.data, at)
        if not t:
            raise PdfError("no trailer")
        trailer, _ = parse(self.data, t.end())
        if isinstance(trailer.get("XRefStm"), int):
            self._stream_section(trailer["XRefStm"], rev, 1)
        return trailer

    def _stream_section(self, at: int, rev: int, rank: int) -> dict:
        value, body = self._indirect(at, None)
        if body is None or plain(value.get("Type")) != "XRef":
            raise PdfError("no cross-reference here")
        widths = [int(w) for w in value["W"]]
        index = value.get("Index") or [0, value["Size"]]
        raw, step, place = self._decoded(value, body), sum(widths), 0
        for first, n in zip(index[::2], index[1::2]):
            for i in range(n):
                fields, p = [], place
                for w in widths:
                    fields.append(int.from_bytes(raw[p : p + w], "big") if w else None)
                    p += w
                place += step
                if p > len(raw):
                    raise PdfError("cross-reference stream is cut")
                kind = {0: "free", 1: "used", 2: "packed"}.get(1 if fields[0] is None else fields[0])
                if kind:
                    self.rows.append((rev, rank, first + i, kind, fields[1] or 0, fields[2] or 0))
        return value

    def _indirect(self, at: int, number: int | None):
        m = _OBJ.match(self.data, at)
        if not m or number is not None and int(m[1]) != number:
            raise PdfError("another object here")
        stop = self.data.find(b"endobj", m.end(), m.end() + REPEATED_BYTES)
        body = self.data[m.end() : stop] if stop >= 0 else b""
        # Behind white space or a closing mark no token goes on; streams are read at their place, and remarks may reach beyond the end.
        if body[-1:] in (b"\n", b"\r", b" ", b">", b"]", b")") and b"stream" not in body and b"%" not in body and (same := _repeated(body)):
            return same[0], None
        value, end = parse(self.data, m.end())
        s = _STREAM.match(self.data, end)
        if not s or not isinstance(value, dict):
            return value, None
        n = value.get("Length")
        if isinstance(n, dict):
            kind, a, _ = self.at.get(n["r"][0], ("free", 0, 0))
            n = self._indirect(a, n["r"][0])[0] if kind == "used" else None
        if not isinstance(n, int) or not _ENDSTREAM.match(self.data, s.end() + n):
            stop = self.data.find(b"endstream", s.end())
            if stop < 0:
                raise PdfError("stream without end")
            return value, self.data[s.end() : stop].removesuffix(b"\n").removesuffix(b"\r")
        return value, self.data[s.end() : s.end() + n]

    @staticmethod
    def _decoded(value: dict, body: bytes) -> bytes:
        return decode_chain(body, [str(plain(f)) for f in as_list(value.get("Filter"))], [plain(p) for p in as_list(value.get("DecodeParms"))])

    def get(self, number: int):
        """(value, stream bytes or None)."""
        kind, a, b = self.at[number]
        if kind == "used":
            return self._indirect(a, number)
        if a not in self.packs:
            value, body = self._indirect(self.at[a][1], a)
            raw = self._decoded(value, body or b"")
            heads = [int(x) for x in raw[: value["First"]].split()]
            self.packs[a] = raw, value["First"], dict(zip(heads[::2], heads[1::2]))
        raw, first, places = self.packs[a]
        if number not in places:
            raise PdfError("not in its object stream")
        return parse(raw, first + places[number])[0], None


    def chased(self, number: int):
        """get(), with an object that is nothing but a reference replaced by what that leads to."""
        value, body = self.get(number)
        for _ in range(CHASE):
            if not (isinstance(value, dict) and value.keys() == {"r"}):
                break
            value, body = self.get(value["r"][0]) if value["r"][0] in self.at else (None, None)
        return value, body


XREF = "rev int, rank int, obj_num long, kind string, offset long, gen long, error string"
OBJECTS = "obj_num long, json string, data binary, error string, gen int"
REVISED = f"{OBJECTS}, older long"


def _xref_rows(data: bytes) -> Iterator[tuple]:
    try:
        for r in File(data).rows:
            yield (*r, None)
    except (PdfError, FilterError, KeyError, IndexError, TypeError, struct.error) as e:
        yield (None, None, None, None, None, None, f"{type(e).__name__}: {e}")


#: Error of an object in an encrypted object stream, before that stream's number.
LOCKED = "locked in object stream "
#: What reading a broken file or object may raise.
BROKEN = (PdfError, FilterError, KeyError, IndexError, TypeError, ValueError)


def object_rows(data: bytes, wanted: Callable[[int], bool] | None = None, types: set[str] | None = None, decode: bool = True, file: File | None = None) -> Iterator[tuple]:
    """Rows of OBJECTS for a file's live objects; a file that can't be read is one row with an error.

    Only objects whose number is `wanted` are parsed, only those of `types` (by their Type entry) are returned, and without
    `decode` no stream is decoded. `file` is the data's, where it is there already.
    """
    try:
        file = file or File(data)
    except BROKEN as e:
        yield (None, None, None, f"{type(e).__name__}: {e}", None)
        return
    if types is None and (wanted is None or wanted(0)):
        yield (0, json.dumps({k: v for k, v in file.trailer.items() if k in ("Root", "Info", "Size", "ID", "Encrypt")}), None, None, 0)
    for number in sorted(n for n, (kind, _, _) in file.at.items() if kind != "free" and (wanted is None or wanted(n))):
        kind, _, gen = file.at[number]
        gen, value, body = gen if kind == "used" else 0, None, None
        try:
            value, body = file.chased(number)
            value = value.decode("latin-1") if isinstance(value, bytes) else value
            if types is not None and object_type(value) not in types:
                continue
            # Encrypted streams are decoded once they are unlocked.
            yield (number, json.dumps(value), (body if body is None or "Encrypt" in file.trailer else file._decoded(value, body)) if decode else None, None, gen)
        except FilterError as e:
            if value is None and kind == "packed" and "Encrypt" in file.trailer:
                if types is None:
                    yield (number, None, None, f"{LOCKED}{file.at[number][1]}", gen)
            elif types is None or object_type(value) in types:
                yield (number, json.dumps(value), body, str(e), gen)
        except BROKEN as e:
            if types is None:
                # What lies in an encrypted object stream waits for the stream to be unlocked.
                locked = kind == "packed" and "Encrypt" in file.trailer
                yield (number, None, None, f"{LOCKED}{file.at[number][1]}" if locked else f"{type(e).__name__}: {e}", gen)


def object_type(value) -> str | None:
    """The Type entry of a dictionary."""
    kind = value.get("Type") if isinstance(value, dict) else None
    return kind.get("n") if isinstance(kind, dict) else None


def revised_rows(data: bytes) -> Iterator[tuple]:
    """Rows of OBJECTS with how many older entries in use each object has under the one that counts; one parse of the file gives both."""
    try:
        file = File(data)
    except BROKEN:
        file = None
    found, under = set(), Counter()
    for _, _, number, kind, _, _ in sorted(file.rows, key=lambda r: r[:2]) if file else ():
        under[number] += number in found and kind == "used"
        found.add(number)
    for row in object_rows(data, file=file):
        yield (*row, under[row[0]])


def packed_rows(data: bytes, first: int) -> Iterator[tuple[int, str]]:
    """(number, JSON) of the objects in an object stream's decoded bytes; what can't be read is left out."""
    try:
        heads = [int(x) for x in data[:first].split()]
    except ValueError:
        return
    for number, at in zip(heads[::2], heads[1::2]):
        try:
            value, _ = parse(data, first + at)
        except BROKEN:
            continue
        yield number, json.dumps(value.decode("latin-1") if isinstance(value, bytes) else value)


def _scan(raw: DataFrame, id_col: str, content_col: str, rows, ddl: str) -> DataFrame:
    names = [x.split()[0] for x in ddl.split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in ddl.split(",")]

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(rows(data or b""))
                for at in range(0, len(found), 2000):
                    part = found[at : at + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), *[pa.array([r[i] for r in part], t) for i, t in enumerate(types)]], names=["doc_id", *names])

    return raw.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).alias("content")).mapInArrow(run, f"doc_id long, {ddl}")


def read_xref(raw: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Every revision's cross-reference entries; rev 0 is the newest, a table's entries (rank 0) come before its stream's (1)."""
    return _scan(raw, id_col, content_col, _xref_rows, XREF)


def ranked(xref: DataFrame) -> DataFrame:
    """Entries with their place among those of their object, 1 for the newest: by revision, and there by rank."""
    order = Window.partitionBy("doc_id", "obj_num").orderBy("rev", "rank")
    return xref.where("error is null").withColumn("place", F.row_number().over(order))


def newest(xref: DataFrame) -> DataFrame:
    """The entry of each object that counts: of the newest revision, and there of the lowest rank."""
    return ranked(xref).where("place = 1").drop("place")


def read_objects(raw: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(doc_id, obj_num, value VARIANT, data, error, gen): live objects with decoded streams; number 0 holds the trailer.

    A file or object that can't be read is a row with an error, never a failed job.
    """
    return _scan(raw, id_col, content_col, object_rows, OBJECTS).select("doc_id", "obj_num", F.parse_json("json").alias("value"), "data", "error", "gen")


def read_revised(raw: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """read_objects with `older`: how many entries of older revisions (or of a lower rank) are under an object's own."""
    return _scan(raw, id_col, content_col, revised_rows, REVISED).select("doc_id", "obj_num", F.parse_json("json").alias("value"), "data", "error", "gen", "older")


def read_pdf(spark, path: str) -> DataFrame:
    """(doc_id, path, length, content) of files; doc_id is a hash of the path, equal in every run."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def startxref(content):
    """Offset behind the last startxref of the final bytes, by column functions alone."""
    tail = F.decode(F.substring(content, -TAIL, TAIL), "ISO-8859-1")
    return F.regexp_extract(tail, r"(?s).*startxref\s+(\d+)", 1).cast("long")


def linearization(content):
    """(L, H, O, E, N, T) of a linearized file's first object within 2048 bytes, else null; by column functions alone."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    first = F.regexp_extract(head, r"(?s)\d+\s+\d+\s+obj\s*<<(.*?)>>", 1)
    number = lambda k: F.regexp_extract(first, rf"/{k}\s+(\d+)", 1).cast("long").alias(k)
    hints = F.regexp_extract(first, r"/H\s*\[([^\]]*)\]", 1)
    return F.when(first.contains("/Linearized"), F.struct(number("L"), F.transform(F.split(F.trim(hints), r"\s+"), lambda x: x.cast("long")).alias("H"), number("O"), number("E"), number("N"), number("T")))
