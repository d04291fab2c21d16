import base64
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirel.functions import codecs as C


def lzw_encode(data: bytes, early: bool = True) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    bits, n, width, size, word = 0, 0, 9, 258, b""
    codes = [(256, 9)]
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        codes.append((table[word], width))
        if size < 4096:
            table[word + bytes([c])] = size
            size += 1
        width = min(12, max(9, (size - 1 + early).bit_length()))
        word = bytes([c])
    if word:
        codes.append((table[word], width))
        size += 1
        width = min(12, max(9, (size - 1 + early).bit_length()))
    codes.append((257, width))
    for code, w in codes:
        bits, n = bits << w | code, n + w
    pad = -n % 8
    return (bits << pad).to_bytes((n + pad) // 8, "big")


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trips(data):
    assert C.flate(zlib.compress(data)) == data
    assert C.ascii_hex(data.hex().encode() + b">junk") == data
    assert C.ascii85(base64.a85encode(data) + b"~>") == data
    assert C.run_length(C._packed_runs(data)) == data
    for early in (True, False):
        assert C.lzw(lzw_encode(data, early), early) == data


def test_specified_lzw_example():
    assert C.lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_edges_and_errors():
    assert C.ascii_hex(b"48 4>") == b"H@" and C.run_length(b"\x02abc") == b"abc" and C.run_length(b"\xfez\x80xx") == b"zzz"
    assert C.ascii85(b"z~>") == bytes(4)
    for bad in (lambda: C.ascii85(b"!~>"), lambda: C.ascii_hex(b"4g>"), lambda: C.run_length(b"\x05ab"), lambda: C.flate(b"no"), lambda: C.decode_chain(b"", ["DCTDecode"]), lambda: C.unpredict(b"\x09a", 15)):
        with pytest.raises(C.FilterError):
            bad()


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_horizontal_predictor(bits):
    rng = np.random.default_rng(bits)
    rows = rng.integers(0, 1 << bits, (5, 7, 3))
    diff = rows.copy()
    diff[:, 1:] = (rows[:, 1:] - rows[:, :-1]) % (1 << bits)

    def packed(x):
        digits = (x.reshape(5, -1)[..., None] >> np.arange(bits)[::-1] & 1).astype(np.uint8).reshape(5, -1)
        return np.packbits(digits, axis=1).tobytes()

    assert C.unpredict(packed(diff), 2, 3, bits, 7) == packed(rows)


def test_row_predictors():
    raw = bytes(range(12))
    rows = b"\x00" + raw[:4] + b"\x02" + bytes(b - a & 255 for a, b in zip(raw[:4], raw[4:8])) + b"\x01" + bytes([raw[8], 1, 1, 1])
    assert C.unpredict(rows, 12, 1, 8, 4) == raw
