"""Stream filters: decoders as plain helpers, and as Arrow-batched column functions."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

#: Fixed value: inflated bytes at most.
INFLATE_MOST = 512 << 20


class FilterError(ValueError):
    """Bytes that a filter can't decode."""


def flate(data: bytes) -> bytes:
    try:
        engine = zlib.decompressobj()
        out = engine.decompress(data, INFLATE_MOST)
    except zlib.error as e:
        raise FilterError(f"flate: {e}") from None
    if engine.unconsumed_tail:
        raise FilterError("flate: too much output")
    return out


def ascii_hex(data: bytes) -> bytes:
    body = b"".join(data.split(b">", 1)[0].replace(b"\0", b"").split())
    try:
        return bytes.fromhex((body + b"0" * (len(body) % 2)).decode("ascii"))
    except ValueError:
        raise FilterError("ascii hex: not a digit") from None


def ascii85(data: bytes) -> bytes:
    body = b"".join(data.split(b"~", 1)[0].replace(b"\0", b"").split())
    out, group = bytearray(), []
    for c in body:
        if c == 122 and not group:
            out += bytes(4)
            continue
        if not 33 <= c <= 117:
            raise FilterError("ascii 85: not a digit")
        group.append(c - 33)
        if len(group) == 5:
            out += _base85(group)
            group = []
    if len(group) == 1:
        raise FilterError("ascii 85: a group of one")
    if group:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    n = 0
    for g in group:
        n = n * 85 + g
    if n >> 32:
        raise FilterError("ascii 85: group too large")
    return n.to_bytes(4, "big")


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        tag = data[at]
        if tag < 128:
            if at + 2 + tag > len(data):
                raise FilterError("run length: cut")
            out += data[at + 1 : at + 2 + tag]
            at += 2 + tag
        else:
            if at + 1 >= len(data):
                raise FilterError("run length: cut")
            out += data[at + 1 : at + 2] * (257 - tag)
            at += 2
    return bytes(out)


def lzw(data: bytes, early: bool = True) -> bytes:
    """Codes of 9 to 12 bits; a cut end gives what was read."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(first)
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> bits - width & (1 << width) - 1
            bits -= width
            held &= (1 << bits) - 1
            if code == 256:
                table, width, last = list(first), 9, b""
                continue
            if code == 257:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise FilterError("lzw: unknown code")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def unpredict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undoes the horizontal predictor (2) or rows with a filter byte (10 and above)."""
    if predictor < 2:
        return data
    step, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2:
        if bits not in (8, 16):
            flat = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, row * 8)[:, : columns * colors * bits]
            parts = flat.reshape(len(flat), columns, colors, bits) @ (1 << np.arange(bits)[::-1])
            summed = np.cumsum(parts, axis=1) % (1 << bits)
            back = (summed[..., None] >> np.arange(bits)[::-1] & 1).astype(np.uint8).reshape(len(flat), -1)
            return np.packbits(back, axis=1).tobytes()
        kind = np.dtype("u1" if bits == 8 else ">u2")
        rows = np.frombuffer(data, kind).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint32).astype(kind).tobytes()
    if len(data) % (row + 1):
        raise FilterError("predictor: rows of another length")
    rows = np.frombuffer(data, np.uint8).reshape(-1, row + 1)
    if (rows[:, 0] > 4).any():
        raise FilterError("predictor: unknown row")
    out, above = np.empty((len(rows), row), np.uint8), np.zeros(row, np.uint8)
    for k, (tag, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        if tag == 1:
            # Each of the step's byte places is a sum over its own bytes.
            wide = np.zeros(-(-row // step) * step, np.uint8)
            wide[:row] = line
            above = np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:row]
        elif tag in (0, 2):
            above = line + above if tag else line
        else:
            above = _by_neighbours(tag, line, above, step)
        out[k] = above
    return out.tobytes()


def _by_neighbours(tag: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row whose bytes are told from their mean neighbours (3) or the nearest of three (4): each needs the one before it."""
    up = above.tolist()
    got: list[int] = []
    for i, x in enumerate(line.tolist()):
        a, b, c = (got[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        guess = (a + b) >> 1
        if tag == 4:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        got.append(x + guess & 255)
    return np.array(got, np.uint8)


#: Names and abbreviations of the filters.
NAMES = {"FlateDecode": "flate", "Fl": "flate", "ASCIIHexDecode": "hex", "AHx": "hex", "ASCII85Decode": "85", "A85": "85", "RunLengthDecode": "run", "RL": "run", "LZWDecode": "lzw", "LZW": "lzw", "Crypt": "crypt"}


def decode_chain(data: bytes, filters: list[str], params: list[dict] | None = None) -> bytes:
    """The filters in their order, each with its parameters; one that isn't known is an error."""
    for i, name in enumerate(filters):
        p = (params[i] if params and i < len(params) else None) or {}
        kind = NAMES.get(name)
        if kind in ("flate", "lzw"):
            data = flate(data) if kind == "flate" else lzw(data, p.get("EarlyChange", 1) != 0)
            data = unpredict(data, int(p.get("Predictor", 1)), int(p.get("Colors", 1)), int(p.get("BitsPerComponent", 8)), int(p.get("Columns", 1)))
        elif kind in ("hex", "85", "run"):
            data = {"hex": ascii_hex, "85": ascii85, "run": run_length}[kind](data)
        else:
            raise FilterError(f"no such filter: {name}")
    return data


@pandas_udf(BinaryType())
def decoded(data: pd.Series, filters: pd.Series) -> pd.Series:
    """Bytes through a list of filter names; null where they can't be decoded."""

    def one(d, f):
        try:
            return None if d is None else decode_chain(d, list(f))
        except FilterError:
            return None

    return pd.Series([one(d, f) for d, f in zip(data, filters)])


@pandas_udf(BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    """zlib at level 6."""
    return data.map(lambda d: None if d is None else zlib.compress(d, 6))


@pandas_udf(BinaryType())
def encoded85(data: pd.Series) -> pd.Series:
    import base64

    return data.map(lambda d: None if d is None else base64.a85encode(d) + b"~>")


_REPEATED = re.compile(rb"(.)\1{1,127}", re.DOTALL)


def _packed_runs(d: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in [*_REPEATED.finditer(d), None]:
        for start in range(at, m.start() if m else len(d), 128):
            part = d[start : min(start + 128, m.start() if m else len(d))]
            out += bytes([len(part) - 1]) + part
        if m:
            out += bytes([257 - len(m[0])]) + m[1]
            at = m.end()
    return bytes(out + b"\x80")


@pandas_udf(BinaryType())
def run_lengths(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else _packed_runs(d))
