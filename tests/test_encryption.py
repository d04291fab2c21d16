"""Files sealed by plain Python: filters by name, strings, and objects packed in a sealed stream."""

import functools
import hashlib
import random
import struct
import time
import zlib

import pandas as pd
from pyspark.sql import functions as F

from quirel.functions import crypto
from quirel.functions.strings import variant_text
from quirel.operators import encryption
from quirel.sources.objects import LOCKED
from quirel.streaming.ingest import ingest, stream_pdf
from tests.test_objects import read, stream_cipher

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
IDENT = b"another file's id"


def md5(data):
    return hashlib.md5(data).digest()


def sealed(filters):
    """A file with a cross-reference stream: a text of its own, a stream, and two objects in a sealed object stream."""
    owner = bytes(range(40, 72))
    key = functools.reduce(lambda d, _: md5(d), range(50), md5(PAD + owner + struct.pack("<i", -4) + IDENT))
    user = functools.reduce(lambda d, i: stream_cipher(bytes(c ^ i for c in key), d), range(20), md5(PAD + IDENT)) + bytes(16)
    seal = lambda n, d: stream_cipher(md5(key + n.to_bytes(3, "little") + b"\0\0"), d)
    stream = lambda d, e="": f"<< /Length {len(d)} {e} >>\nstream\n".encode() + d + b"\nendstream"
    inner = [b"<< /Title (packed title) /Kids [(a) <62>] >>", b"(packed alone)"]
    heads = f"7 0 8 {len(inner[0]) + 1} ".encode()
    pack = zlib.compress(heads + b"\n".join(inner))
    bodies = {
        1: b"<< /Type /Catalog /Pages 7 0 R >>",
        2: b"<< /Title <" + seal(2, b"own title").hex().encode() + b"> /Deep [<< /s <" + seal(2, b"s").hex().encode() + b"> >> (" + b"".join(b"\\%03o" % c for c in seal(2, b"octal (text)")) + b") /s#22#3A#22ab#22] >>",
        3: stream(seal(3, b"sealed stream")),
        4: stream(seal(4, pack), f"/Type /ObjStm /N 2 /First {len(heads)} /Filter /FlateDecode"),
        5: f"<< /Filter /Standard /V 4 /R 4 /Length 128 /P -4 /O <{owner.hex()}> /U <{user.hex()}> {filters} >>".encode(),
        9: b"<< /Type /Sig /Contents <" + b"00ff" + b"> /ByteRange [0 1 2 3] >>",
    }
    out, places = b"%PDF-1.6\n", {}
    for n, body in bodies.items():
        places[n] = len(out)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    rows = [(0, 0, 0)] + [(1, places[n], 0) if n in places else (2, 4, n - 7) if n in (7, 8) else (0, 0, 0) for n in range(1, 10)] + [(1, start, 0)]
    table = b"".join(struct.pack(">BIH", *r) for r in rows)
    xref = stream(table, f"/Type /XRef /W [1 4 2] /Size 11 /Root 1 0 R /Encrypt 5 0 R /ID [<{IDENT.hex()}> <00>]")
    return out + b"10 0 obj\n" + xref + b"\nendobj\nstartxref\n" + str(start).encode() + b"\n%%EOF"


RC4 = "/CF << /Std << /CFM /V2 >> >> /StmF /Std /StrF /Std"


def test_strings_and_packed_objects(spark):
    objects = read(spark, sealed(RC4)).checkpoint()
    assert {r.obj_num: r.error for r in objects.where("error is not null").collect()} == {7: f"{LOCKED}4", 8: f"{LOCKED}4"}
    found = encryption.unlocked(objects).checkpoint()
    rows = {r.obj_num: r for r in found.select("obj_num", F.to_json("value").alias("json"), "data", "error", variant_text(F.col("value"), "$.Title").alias("title")).collect()}
    assert len(rows) == found.count() == objects.count() and {r.error for r in rows.values()} == {None}
    hex_ = lambda t: t.encode().hex()
    assert rows[2].title == "own title" and hex_("octal (text)") in rows[2].json and f'{{"s":{{"h":true,"s":"{hex_("s")}"}}}}' in rows[2].json and 's\\":\\"ab' in rows[2].json
    assert bytes(rows[3].data) == b"sealed stream" and rows[7].title == "packed title" and rows[8].json == f'{{"s":"{hex_("packed alone")}"}}'
    assert '"00ff"' in rows[9].json and rows[5].json == objects.where("obj_num = 5").select(F.to_json("value").alias("j")).first().j


def test_filters_by_name(spark):
    # Streams are plain here, so what was sealed stays sealed; strings follow their own filter.
    files = read(spark, sealed(RC4.replace("/StmF /Std", "/StmF /Identity")), sealed(RC4.replace("/StrF /Std", "")), sealed(RC4.replace("/StmF /Std", "/StmF /Gone")), sealed(RC4.replace("/CFM /V2", "/CFM /None"))).checkpoint()
    found = {(r.doc_id, r.obj_num): r for r in encryption.unlocked(files).select("doc_id", "obj_num", variant_text(F.col("value"), "$.Title").alias("title"), "data", "error").collect()}
    assert found[0, 2].title == found[2, 2].title == "own title" and "own title" not in (found[1, 2].title, found[3, 2].title)
    assert [bytes(found[d, 3].data or b"") == b"sealed stream" for d in range(4)] == [False, True, False, False]
    assert found[2, 3].error == "crypt filter: no filter Gone" and {found[0, 3].error, found[1, 3].error, found[3, 3].error} == {None}
    assert found[1, 7].title == "packed title" and found[0, 7].error.startswith(LOCKED)


def test_streamed_tables_can_be_unlocked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(sealed(RC4))
    ingest(stream_pdf(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "obj_num", F.parse_json("json").alias("value"), "data", "error", "gen")
    assert bytes(encryption.unlocked(rows.checkpoint()).where("obj_num = 3").first().data) == b"sealed stream"


def test_ciphers_of_many_rows_run_side_by_side():
    rng = random.Random(3)
    keys = [rng.choice([None, b"", rng.randbytes(5), rng.randbytes(16)]) for _ in range(600)]
    data = [rng.choice([None, b"", rng.randbytes(rng.randrange(900)), rng.randbytes(20)]) for _ in range(600)]
    assert list(crypto.rc4.func(pd.Series(keys, dtype=object), pd.Series(data, dtype=object))) == [crypto._rc4(k, d) if k and d is not None else None for k, d in zip(keys, data)]
    keys = [rng.randbytes(16) for _ in range(3000)]
    began = time.process_time()
    one_by_one = [crypto._rc4(k, bytes(16)) for k in keys]
    alone, began = time.process_time() - began, time.process_time()
    # Twenty ciphers a row, in less time than five of them take one by one.
    assert len(set(crypto.user_entry_r3.func(pd.Series(keys), pd.Series([b""] * 3000)))) == len(set(one_by_one)) == 3000
    assert time.process_time() - began < 5 * alone
