"""Other things that content streams hold: marked-content events and inline images."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions.codecs import FilterError, decode_chain
from quirel.sources.objects import PdfError, as_list, parse, plain

from .pages import pages
from .text import page_contents

#: Abbreviated keys and colour spaces of inline images, and their image codecs.
SHORT = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "DP": "DecodeParms", "IM": "ImageMask", "D": "Decode", "I": "Interpolate"}
SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
CODECS = {"DCT": "DCTDecode", "DCTDecode": "DCTDecode", "CCF": "CCITTFaxDecode", "CCITTFaxDecode": "CCITTFaxDecode"}
_END = re.compile(rb"\sEI(?=\s|\Z)")


def _operators(content: bytes) -> Iterator[tuple[str, list, int]]:
    """(operator, operands, place behind it); the places of BI tell where an inline image begins."""
    at, args = 0, []
    while True:
        try:
            value, at = parse(content, at)
        except PdfError:
            return
        if not isinstance(value, bytes):
            args.append(value)
            continue
        yield value.decode("latin-1"), args, at
        args = []
        if value == b"ID":
            end = _END.search(content, at)
            at = end.end() if end else len(content)


def _marked(content: bytes) -> Iterator[tuple]:
    for op, args, _ in _operators(content):
        if op in ("MP", "DP", "BMC", "BDC", "EMC"):
            tag = args[0].get("n") if args and isinstance(args[0], dict) else None
            yield op, tag, json.dumps(args[1]) if len(args) > 1 else None


def _inline(content: bytes) -> Iterator[tuple]:
    for op, args, at in _operators(content):
        if op != "ID":
            continue
        keys = {SHORT.get(k["n"], k["n"]): plain(v) for k, v in zip(args[::2], args[1::2]) if isinstance(k, dict) and "n" in k}
        end = _END.search(content, at)
        raw = content[at + 1 : end.start() if end else len(content)]
        filters = [str(f) for f in as_list(keys.get("Filter"))]
        codec = next((CODECS[f] for f in filters if f in CODECS), None)
        try:
            data = raw if codec else decode_chain(raw, filters, as_list(keys.get("DecodeParms")))
            error = None
        except FilterError as e:
            data, error = None, str(e)
        space = keys.get("ColorSpace")
        yield keys.get("Width"), keys.get("Height"), keys.get("BitsPerComponent", 1 if keys.get("ImageMask") else 8), SPACES.get(space, space) if isinstance(space, str) else None, codec, bool(keys.get("ImageMask")), data, error


def _rows(objects: DataFrame, found: Callable[[bytes], Iterator[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    inputs = page_contents(objects, pages(objects))
    arrow = pa.schema([("doc_id", pa.int64()), ("page_index", pa.int32()), ("seq", pa.int32()), *[(n, t) for n, _, t in fields]])

    def walk(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = [dict(zip(arrow.names, (r["doc_id"], r["page_index"], i, *row))) for i, row in enumerate(found(r["content"].encode("latin-1")))]
                for at in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 2000], schema=arrow)

    return inputs.mapInArrow(walk, "doc_id long, page_index int, seq int, " + ", ".join(f"{n} {k}" for n, k, _ in fields))


def marked_content(objects: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, op, tag, properties, depth): depth is a running count of opened less closed."""
    events = _rows(objects, _marked, [("op", "string", pa.string()), ("tag", "string", pa.string()), ("properties", "string", pa.string())])
    step = F.when(F.col("op").isin("BMC", "BDC"), 1).when(F.col("op") == "EMC", -1).otherwise(0)
    return events.withColumn("depth", F.sum(step).over(Window.partitionBy("doc_id", "page_index").orderBy("seq")).cast("int"))


def inline_images(objects: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, width, height, bits, color_space, codec, is_mask, data, error); an image codec's data stay as they are."""
    return _rows(objects, _inline, [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("bits", "int", pa.int32()), ("color_space", "string", pa.string()), ("codec", "string", pa.string()), ("is_mask", "boolean", pa.bool_()), ("data", "binary", pa.binary()), ("error", "string", pa.string())])
