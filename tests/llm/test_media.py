import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirel.llm import media, queries


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(data) and set(payload[len(data) :]) <= {32}
    pixels = media.png_decode(media.png_encode(payload))
    assert pixels.tobytes() == payload and pixels.shape[1:] == (64, 3)
    assert len(media.cosine_hash(pixels)) == 8


def reference_unfilter(rows, bpp):
    out = []
    for row in rows:
        kind, line = row[0], list(row[1:])
        above = out[-1] if out else [0] * len(line)
        for i in range(len(line)):
            a = line[i - bpp] if i >= bpp else 0
            b = above[i]
            c = above[i - bpp] if i >= bpp else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[i] = (line[i] + [0, a, b, (a + b) // 2, near][kind]) % 256
        out.append(line)
    return np.array(out, np.uint8)


def test_all_filters_are_undone():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (40, 1 + 30), dtype=np.uint8)
    rows[:, 0] = rng.integers(0, 5, 40)
    for bpp in (1, 3):
        assert (media._unfiltered(rows, bpp) == reference_unfilter(rows.tolist(), bpp)).all()


def test_checksums_and_forms_are_tested():
    good = media.png_encode(media.padded(b"some text" * 100))
    bad = bytearray(good)
    bad[60] ^= 1
    cases = [b"", good[:-5], bytes(bad), b"x" + good[1:]]
    head = struct.pack(">IIBBBBB", 64, 1, 16, 2, 0, 0, 0)
    cases.append(media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(b"")) + media._chunk(b"IEND", b""))
    for c in cases:
        with pytest.raises(media.MediaError):
            media.png_decode(c)


def test_hash_moves_little_for_like_pictures():
    y, x = np.mgrid[0:64, 0:64]
    picture = np.repeat((127 + 90 * np.sin(x / 9) * np.cos(y / 13))[:, :, None], 3, 2).astype(np.uint8)
    shifted = np.clip(picture.astype(int) + np.random.default_rng(0).integers(-6, 7, picture.shape), 0, 255).astype(np.uint8)
    bits = lambda p: int.from_bytes(media.cosine_hash(p), "big")
    assert (bits(picture) ^ bits(shifted)).bit_count() <= 6


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        payload = docs[r.doc_id] + b" " * (-len(docs[r.doc_id]) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_nulls_repeats_and_broken_files(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a"), (2, "x" * 300_000)], "doc_id long, text string").withColumns({"media": F.lit(1), "payload": F.lit(2)})
    rows = media.read_media(media.encode_media(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.payload), r.media_error) for r in rows) == [(0, 1, 192, None), (1, 0, 192, None), (1, 0, 192, None), (2, 300_000, 300_096, None)]
    assert len({r.media for r in rows if r.doc_id == 1}) == 1
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no"))], "doc_id long, media binary")
    assert [r.payload for r in media.read_media(bad).collect()] == [None, None]
    assert media.read_media(media.encode_media(docs.where("false"))).collect() == []
