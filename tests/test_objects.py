import functools
import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quirel.operators import catalogue, encryption, pages, text
from quirel.sources import objects as O
from quirel.sources import writer as W


def pdf(*bodies, extra=""):
    out, at = b"%PDF-1.7\n", []
    for i, b in enumerate(bodies, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n".encode() + (b if isinstance(b, bytes) else b.encode("latin-1")) + b"\nendobj\n"
    table = f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n" + "".join(f"{a:010d} 00000 n \n" for a in at)
    return out + (table + f"trailer\n<< /Root 1 0 R /Size {len(bodies) + 1} {extra} >>\nstartxref\n{len(out)}\n%%EOF").encode()


def stream(data, entries=""):
    return f"<< /Length {len(data)} {entries} >>\nstream\n{data}\nendstream"


FONT = "<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [" + "520 " * 95 + "] >>"


def page(content, font=FONT, entries=""):
    return pdf("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 400 640] /Resources << /Font << /F0 4 0 R >> >> /Contents 5 0 R {entries} >>", font, stream(content))


def read(spark, *files):
    raw = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "doc_id long, content binary")
    return O.read_objects(raw).persist()


def lines(spark, content, **kw):
    return [r.text for r in text.run_lines(text.runs(read(spark, page(content, **kw)))).orderBy("page_index", "line_seq").collect()]


def test_parse_kinds():
    got, _ = O.parse(b"<< /A#20b [1 -2.5 (a\\(b\\)\\101(c)) <4 8 4> 3 0 R true null /N] %c\n /D << /E /F >> >>")
    assert got == {"A b": [1, -2.5, {"s": b"a(b)A(c)".hex()}, {"s": "4840", "h": True}, {"r": [3, 0]}, True, None, {"n": "N"}], "D": {"E": {"n": "F"}}}
    for bad in (b"<<", b"(", b"]", b"[" * 300 + b"]" * 300):
        with pytest.raises(O.PdfError):
            O.parse(bad)


def test_text_of_a_page(spark):
    assert lines(spark, "BT /F0 9 Tf 41 333 Td (A first line) Tj ET") == ["A first line"]


@pytest.mark.parametrize(
    "shown, want",
    [("[(a) -200 (b)] TJ", "a b"), ("[(a) -100 (b)] TJ", "ab"), ("[(a) 500 (b)] TJ", "ab"), ("[(a ) -300 (b)] TJ", "a b"), ("(a) Tj 3 0 Td (b) Tj", "a"), ("(one) Tj 100 0 Td (two) Tj", "one two"), ("(x) ' (y) '", None)],
)
def test_words(spark, shown, want):
    got = lines(spark, f"BT /F0 10 Tf 12 TL 100 200 Td {shown} ET")
    assert got == ["x", "y"] if want is None else got[0].startswith(want)


def test_three_producers_one_text(spark):
    ways = ["[(two)-300(words)] TJ", "(two words) Tj", "(two) Tj 20 0 Td (words) Tj"]
    assert {tuple(lines(spark, f"BT /F0 10 Tf 50 700 Td {w} ET")) for w in ways} == {("two words",)}


def test_encodings(spark):
    differences = "<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [65 /eacute /uni0416 /f_f /nosuch] >> >>"
    assert lines(spark, "BT /F0 9 Tf 5 5 Td (ABCDE) Tj ET", font=differences) == ["éЖff�E"]
    assert lines(spark, "BT /F0 9 Tf 5 5 Td (caf\\351 \\200) Tj ET") == ["café €"]


def test_wide_fonts(spark):
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0041> <0043> <0416> <0050> <0051> [<00660069> <4E2D>] endbfrange"
    file = pdf(
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Resources << /Font << /F0 4 0 R >> >> /Contents 5 0 R >>",
        "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", stream("BT /F0 10 Tf 5 5 Td <0041004200500051> Tj <0043> Tj ET"), "<< /Type /Font /Subtype /CIDFontType2 /DW 500 /W [65 [1000 250] 80 81 2000] >>", stream(cmap),
    )
    rows = text.runs(read(spark, file)).orderBy("run_seq").collect()
    assert [r.text for r in rows] == ["ЖЗfi中", "И"] and abs(rows[0].adv_x - 52.5) < 1e-4 and abs(rows[1].x - 57.5) < 1e-4


def test_states_forms_and_marks(spark):
    objects = read(spark, page("/P << /MCID 4 >> BDC BT /F0 10 Tf 3 Tr 2 0 0 2 10 20 Tm (big) Tj ET EMC /Artifact BMC BT (foot) Tj ET EMC q 1 0 0 1 5 5 cm BT 1 1 Td (in) Tj ET Q (out) Tj"))
    runs = text.runs(objects).orderBy("run_seq").collect()
    assert [(r.text, r.mcid, r.artifact, r.render_mode) for r in runs] == [("big", 4, False, 3), ("foot", None, True, 3), ("in", None, False, 3)]
    assert (runs[0].x, runs[0].y) == (10.0, 20.0) and (runs[2].x, runs[2].y) == (6.0, 6.0)
    assert text.visible(text.runs(objects)).count() == 0


def test_packed_objects_and_hybrid_tables(spark):
    pack = "5 0 (packed)"
    body = [f"<< /Type /Catalog /X 5 0 R >>", stream(pack, "/Type /ObjStm /N 1 /First 4")]
    out, at = b"%PDF-1.5\n", {}
    for i, b in enumerate(body, 1):
        at[i] = len(out)
        out += f"{i} 0 obj\n{b}\nendobj\n".encode()
    rows = [(0, 0, 0), (1, at[1], 0), (1, at[2], 0), (1, len(out), 0), (0, 0, 0), (2, 2, 0)]
    data = b"".join(bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows)
    out += b"3 0 obj\n" + f"<< /Type /XRef /Size 6 /W [1 2 1] /Root 1 0 R /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    out += f"startxref\n{out.rfind(b'3 0 obj')}\n%%EOF".encode()
    got = read(spark, out)
    assert [r.v for r in got.where("obj_num = 5").select(F.try_variant_get("value", "$.s", "string").alias("v")).collect()] == [b"packed".hex()]


def test_tree_cycles_and_modes(spark):
    loop = pdf("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [2 0 R 3 0 R 4 0 R] >>", "<< /Type /Page >>", "<< /Kids [] >>")
    objects = read(spark, loop)
    assert [r.page_obj for r in pages.pages(objects).collect()] == [3]
    assert {r.severity for r in pages.hierarchy_issues(objects).collect()} == {"error", "warning"}


def test_broken_files_are_rows(spark):
    good, rng = page("BT /F0 9 Tf 41 333 Td (Still here) Tj ET"), random.Random(4)
    files = [b"", b"junk", good[:-30]]
    for _ in range(120):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 8)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        files.append(bytes(bad))
    objects = read(spark, *files, good)
    assert objects.where("error is not null").count() >= 3
    got = text.runs(objects).collect()
    assert any(r.doc_id == len(files) and r.text == "Still here" for r in got)
    assert O.read_xref(spark.createDataFrame([(1, bytearray(b"junk"))], "doc_id long, content binary")).first().error


def test_written_files_on_disk(spark, tmp_path):
    parts = spark.createDataFrame([(7, 1, "<< /Type /Catalog >>"), (7, 2, "(x)")], "doc_id long, obj_num long, body string")
    W.write_pdf(W.assemble(parts), str(tmp_path))
    found = O.read_pdf(spark, str(tmp_path / "*.pdf"))
    assert found.count() == 1 and O.read_objects(found).where("error is null").count() == 3
    assert found.select(O.startxref(F.col("content")).alias("s")).first().s > 0


def test_linearization(spark):
    data = b"%PDF-1.4\n1 0 obj\n<< /Linearized 1 /L 999 /H [10 20] /O 3 /E 500 /N 2 /T 900 >>\nendobj\n"
    rows = spark.createDataFrame([(bytearray(data),), (bytearray(b"%PDF-1.4\n1 0 obj\n<< >>\nendobj"),)], "content binary").select(O.linearization(F.col("content")).alias("l")).collect()
    assert rows[0].l.asDict() == {"L": 999, "H": [10, 20], "O": 3, "E": 500, "N": 2, "T": 900} and rows[1].l is None


def test_signatures_and_timestamps(spark):
    f = pdf("<< /Type /Catalog >>", "<< /FT /Sig /T (s) /V 3 0 R >>", "<< /Type /Sig /SubFilter /ETSI.RFC3161 /ByteRange [0 5 9 4] /Contents <0102> /M (D:20240102030405+01'30') >>")
    r = catalogue.signatures(read(spark, f)).first()
    assert (r.sub_filter, r.byte_range, bytes(r.contents), r.signed_at, r.is_timestamp) == ("ETSI.RFC3161", [0, 5, 9, 4], b"\x01\x02", "2024-01-02T03:04:05+01:30", True)


def test_forms_have_scopes_of_their_own(spark):
    font, form = "<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman /Encoding /WinAnsiEncoding >>", "/Type /XObject /Subtype /Form"
    differs = "<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [97 /alpha /uni03B2] >> >>"
    file = pdf(
        "<< /Type /Catalog /Pages 2 0 R >>",
        "<< /Type /Pages /Kids 9 0 R /Resources 10 0 R >>",
        "<< /Type /Page /Contents [4 0 R] >>",
        stream("BT /A 8 Tf 10 90 Td (ab) Tj ET /P Do /P Do BT /A 8 Tf 10 10 Td (ab) Tj ET"),
        stream("BT /A 8 Tf 10 70 Td (b) Tj ET /Q Do", f"{form} /Resources << /Font << /A {differs} >> /XObject << /Q 6 0 R >> >>"),
        stream("BT /A 8 Tf 10 50 Td (b) Tj ET /P Do /Q Do", form),
        font,
        "<< /A 7 0 R >>",
        "[3 0 R]",
        "<< /Font 8 0 R /XObject << /P 5 0 R >> >>",
    )
    got = [(r.text, r.y) for r in text.runs(read(spark, file)).orderBy("run_seq").collect()]
    # A form without resources sees those of the form that paints it; what is being painted isn't painted again.
    assert got == [("ab", 90.0), ("β", 70.0), ("β", 50.0), ("β", 70.0), ("β", 50.0), ("ab", 10.0)]


def test_indirect_and_broken_page_entries(spark):
    good = pdf("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids 4 0 R /MediaBox 5 0 R /Rotate 6 0 R >>", "<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>", "[3 0 R]", "[0 0 10 20]", "90", "[8 0 R 9 0 R]", stream("q"), stream("Q"))
    broken = [pdf("<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids {k} /MediaBox {k} >>", "(x)", "<< /Type /Page /MediaBox [1] /Contents (x) /Rotate [] >>") for k in ("7", "3 0 R", "99 0 R", "(s)", "<< >>", "[4 0 R 7 (x) [4 0 R]]")]
    objects = read(spark, good, *broken)
    rows = {r.doc_id: r for r in pages.pages(objects).collect()}
    assert (rows[0].width, rows[0].height, rows[0].rotate, rows[0].contents) == (10.0, 20.0, 90, [8, 9])
    assert sorted(rows) == [0, 6] and (rows[6].width, rows[6].rotate, rows[6].contents) == (595.0, 0, [])
    issues = pages.hierarchy_issues(objects).where(F.col("message") == "Kids isn't an array")
    assert sorted(r.doc_id for r in issues.collect()) == [1, 2, 3, 4, 5]


def stream_cipher(key, data):
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) % 256
        s[i], s[j] = s[j], s[i]
    out, i, j = [], 0, 0
    for c in data:
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) % 256])
    return bytes(out)


def sealed_file(user, owner, revision, metadata=True):
    """A file under 128-bit keys by plain Python: a predicted stream of generation 3, a metadata stream and an Identity one."""
    md5 = lambda d: hashlib.md5(d).digest()
    pad = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
    turned = lambda key, data, turns: functools.reduce(lambda d, i: stream_cipher(bytes(c ^ i for c in key), d), turns, data)
    top = functools.reduce(lambda d, _: md5(d), range(51), (owner + pad)[:32])
    o = turned(top, (user + pad)[:32], range(20))
    ident = b"file identifier."
    key = md5((user + pad)[:32] + o + struct.pack("<i", -1340) + ident + (b"" if metadata else b"\xff" * 4))
    key = functools.reduce(lambda d, _: md5(d), range(50), key)
    u = turned(key, md5(pad + ident), range(20)) + bytes(16)
    seal = lambda n, g, d: stream_cipher(md5(key + n.to_bytes(3, "little") + g.to_bytes(2, "little")), d)
    rows = zlib.compress(bytes([2, 1, 2, 3, 2, 1, 1, 1]))
    body = lambda d, e: f"<< /Length {len(d)} {e} >>\nstream\n".encode() + d + b"\nendstream"
    xmp = b"<x/>"
    objects = [
        (1, 0, b"<< /Type /Catalog >>"),
        (2, 3, body(seal(2, 3, rows), "/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 3 >>")),
        (3, 0, body(seal(3, 0, xmp) if metadata else xmp, "/Type /Metadata")),
        (4, 0, body(b"clear", "/Filter [/Crypt] /DecodeParms [<< /Name /Identity >>]")),
        (5, 0, body(seal(5, 0, b"named"), "/Filter [/Crypt] /DecodeParms [<< /Name /StdCF >>]")),
        (6, 0, f"<< /Filter /Standard /V {revision if revision == 4 else 2} /R {revision} /Length 128 /P -1340 /O <{o.hex()}> /U <{u.hex()}> {'' if metadata else '/EncryptMetadata false'} /CF << /StdCF << /CFM /V2 >> >> /StmF /StdCF >>".encode()),
    ]
    out, table = b"%PDF-1.6\n", "xref\n0 7\n0000000000 65535 f \n"
    for n, g, b in objects:
        table += f"{len(out):010d} {g:05d} n \n"
        out += f"{n} {g} obj\n".encode() + b + b"\nendobj\n"
    return out + f"{table}trailer\n<< /Root 1 0 R /Size 7 /Encrypt 6 0 R /ID [<{ident.hex()}> <00>] >>\nstartxref\n{len(out)}\n%%EOF".encode()


def test_passwords_generations_and_parameters_of_sealed_streams(spark):
    objects = read(spark, sealed_file(b"guest", b"boss", 3), sealed_file(b"guest", b"boss", 4), sealed_file(b"guest", b"boss", 4, metadata=False))
    want = {2: bytes([1, 2, 3, 2, 3, 4]), 3: b"<x/>", 4: b"clear", 5: b"named"}
    for password in (b"guest", b"boss"):
        got = {(r.doc_id, r.obj_num): bytes(r.data) for r in encryption.unlocked(objects, password).where("data is not null").collect()}
        assert got == {(d, n): v for d in range(3) for n, v in want.items()}
    refused = encryption.unlocked(objects, b"thief")
    assert {r.error for r in refused.where("obj_num = 2").collect()} == {"wrong password"}


def test_repeated_objects_are_read_as_others_are():
    for body, value in ((b" (a endobj b)\n", {"s": b"a endobj b".hex()}), (b" [1 % ]\n]\n", [1]), (b" << /A 5 % >>\n>>\n", {"A": 5}), (b" true ", True), (b"<41>", {"s": "41", "h": True})):
        head = b"%PDF-1.7\n1 0 obj" + body + b"endobj\n"
        data = head + b"xref\n0 2\n0000000000 65535 f \n0000000009 00000 n \ntrailer\n<< /Root 1 0 R >>\nstartxref\n%d\n" % len(head)
        O._repeated.cache_clear()
        assert [O.File(data).get(1) for _ in range(2)] == [(value, None)] * 2
    assert O._repeated.cache_info().hits == 1
