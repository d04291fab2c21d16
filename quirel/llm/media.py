"""Media columns: bytes as PNG files in binary columns, read back with checks, and perceptual hashes of the pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_texts, text_or_empty

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: 64 pixels of three 8-bit samples: a row is 192 bytes.
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
PAD = 32
#: Bytes of an IDAT chunk and zlib's level.
IDAT, LEVEL = 1 << 16, 1


class MediaError(ValueError):
    """The bytes aren't a PNG of the kind that is read here, or a checksum differs."""


def padded(data: bytes) -> bytes:
    """data with bytes 32 up to a positive multiple of a row."""
    return data + bytes([PAD]) * (-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(pixels: np.ndarray, bpp: int) -> np.ndarray:
    """Rows behind their filter byte: of None, Sub and Up the one with the smallest sum of absolute differences."""
    sub = pixels.copy()
    sub[:, bpp:] -= pixels[:, :-bpp]
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    kinds = np.stack([pixels, sub, up])
    pick = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    return np.concatenate([pick[:, None].astype(np.uint8), kinds[pick, np.arange(len(pixels))]], axis=1)


def png_encode(payload: bytes, width: int = WIDTH, channels: int = CHANNELS) -> bytes:
    """An RGB (3) or grey (1) PNG whose samples are payload, which must fill its rows."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width * channels)
    packed = zlib.compress(_filtered(pixels, channels).tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", width, len(pixels), 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _chunks(media: bytes):
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(media):
        if at + 12 > len(media):
            raise MediaError("cut chunk")
        n = struct.unpack_from(">I", media, at)[0]
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise MediaError(f"checksum of chunk {kind!r}")
        yield kind, data
        at += 12 + n


def _unfiltered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of filtered rows; whole runs of a filter are undone at once where it allows that."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        out[sub] = np.cumsum(out[sub].reshape(len(sub), -1, bpp), axis=1, dtype=np.uint8).reshape(len(sub), -1)
    begins = np.flatnonzero(np.diff(kinds, prepend=255))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(kinds)]):
        if kinds[a] == 2:
            first = max(a - 1, 0)
            out[first:b] = np.cumsum(out[first:b], axis=0, dtype=np.uint8)
        elif kinds[a] > 2:
            for r in range(a, b):
                _undo_row(out[r].reshape(-1, bpp), out[r - 1].reshape(-1, bpp) if r else np.zeros((out.shape[1] // bpp, bpp), np.uint8), kinds[a] == 4)
    return out


def _undo_row(row: np.ndarray, above: np.ndarray, paeth: bool) -> None:
    left = corner = np.zeros(row.shape[1], np.int16)
    for x, up in enumerate(above.astype(np.int16)):
        if paeth:
            a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        else:
            guess = (left + up) // 2
        left, corner = (row[x] + guess) & 255, up
        row[x] = left


def png_decode(media: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit grey or RGB PNG without interlacing; every chunk's checksum is tested."""
    packed, size = [], None
    for kind, data in _chunks(media):
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", data)
            if depth != 8 or colour not in (0, 2) or any(rest):
                raise MediaError("not 8-bit grey or RGB")
            size = height, width, 3 if colour == 2 else 1
        elif kind == b"IDAT":
            packed.append(data)
    if size is None:
        raise MediaError("no header")
    height, width, channels = size
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from None
    if len(raw) != height * (1 + width * channels):
        raise MediaError("wrong number of samples")
    return _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), channels).reshape(size)


_N, _LOW = 32, 8
_COSINES = np.cos(np.pi / _N * (np.arange(_N) + 0.5) * np.arange(_LOW)[:, None])


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 x 8 cosine coefficients of a 32 x 32 grey image exceed their median."""
    grey = pixels.sum(axis=2, dtype=np.float64)
    for axis in (0, 1):
        n = grey.shape[axis]
        edges = np.arange(_N) * n // _N
        if n >= _N:
            grey = np.add.reduceat(grey, edges, axis=axis) / np.expand_dims(np.diff(edges, append=n), 1 - axis)
        else:
            grey = grey.take(edges, axis=axis)
    low = (_COSINES @ grey @ _COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, media (a PNG of the text's UTF-8 bytes, padded to whole rows).

    Null and empty text is one row of padding. Equal texts give equal files. Other columns are ignored.
    """
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    found = map_texts(rows, "body", lambda: lambda texts: {"media": [png_encode(padded(t)) for t in texts]}, "media binary", as_bytes=True)
    return found.withColumnRenamed("id", id_col)


def read_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows with payload (the samples), phash (8 bytes) and media_error; null or broken files have null results and the error's text."""

    def read(media: bytes | None):
        try:
            pixels = png_decode(media or b"")
            return pixels.tobytes(), cosine_hash(pixels), None
        except MediaError as e:
            return None, None, str(e)

    def apply(files):
        found = [read(m) for m in files]
        return {name: [x[i] for x in found] for i, name in enumerate(("payload", "phash", "media_error"))}

    return map_texts(rows, media_col, lambda: apply, "payload binary, phash binary, media_error string", drop=False)
