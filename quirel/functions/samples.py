"""Image samples to pixels, in Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

#: Fixed value: bytes of a decoded image at most.
PIXELS_MOST = 64 << 20


def unpack(data: bytes, width: int, height: int, channels: int, bits: int) -> np.ndarray | None:
    """Samples (height, width, channels) of rows that are filled up to bytes; missing rows are zero."""
    row = (width * channels * bits + 7) // 8
    if width <= 0 or height <= 0 or bits not in (1, 2, 4, 8, 16) or width * height * 4 > PIXELS_MOST:
        return None
    raw = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    if bits == 8:
        flat = raw
    elif bits == 16:
        flat = raw.reshape(height, -1, 2)[:, :, 0]
    else:
        shifts = np.arange(8 - bits, -1, -bits)
        flat = (raw[:, :, None] >> shifts & (1 << bits) - 1).reshape(height, -1)
    return flat[:, : width * channels].reshape(height, width, channels)


def rgba(data: bytes, width: int, height: int, bits: int, space: str, decode: list[float] | None = None, palette: bytes | None = None) -> bytes | None:
    """Pixels of grey, RGB, CMYK or indexed samples, with their Decode array; None where the form isn't known."""
    channels = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4, "Indexed": 1}.get(space)
    got = unpack(data, width, height, channels, bits) if channels else None
    if got is None:
        return None
    top = 255 if bits in (8, 16) else (1 << bits) - 1
    if space == "Indexed":
        table = np.frombuffer(palette or b"", np.uint8)
        table = table[: len(table) // 3 * 3].reshape(-1, 3)
        if not len(table):
            return None
        colour = table[np.minimum(got[:, :, 0], len(table) - 1)].astype(float) / 255
    else:
        values = got / top
        if decode and len(decode) == 2 * channels:
            low, high = np.array(decode[::2]), np.array(decode[1::2])
            values = low + values * (high - low)
        colour = np.repeat(values, 3, axis=2) if channels == 1 else values if channels == 3 else 1 - np.minimum(values[:, :, :3] + values[:, :, 3:], 1)
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, :3] = np.floor(np.clip(colour, 0, 1) * 255 + 0.5)
    return out.tobytes()


def resample(pixels: bytes, width: int, height: int, to_width: int, to_height: int) -> bytes:
    """Nearest neighbours."""
    p = np.frombuffer(pixels, np.uint8).reshape(height, width, -1)
    return p[np.arange(to_height) * height // to_height][:, np.arange(to_width) * width // to_width].tobytes()


@pandas_udf(BinaryType())
def image_rgba(data: pd.Series, width: pd.Series, height: pd.Series, bits: pd.Series, space: pd.Series) -> pd.Series:
    """Pixels of image columns; null where any part is missing or the form isn't known."""
    rows = zip(data, width, height, bits, space)
    return pd.Series([None if d is None or s is None or pd.isna(w) or pd.isna(h) or pd.isna(b) else rgba(d, int(w), int(h), int(b), s) for d, w, h, b, s in rows])


@pandas_udf(BinaryType())
def stencil_coverage(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """A byte of coverage for each pixel of a stencil: zero bits paint."""

    def one(d, w, h):
        got = None if d is None else unpack(d, int(w), int(h), 1, 1)
        return None if got is None else ((1 - got[:, :, 0]) * 255).astype(np.uint8).tobytes()

    return pd.Series([one(*x) for x in zip(data, width, height)])
