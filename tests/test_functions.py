import math

from pyspark.sql import functions as F

from quirel.functions import calculator, colour, crypto, samples, strings


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_dates(spark):
    cases = {"D:20240102": "2024-01-02", "D:2024": "2024", "D:20240102030405Z": "2024-01-02T03:04:05Z", "D:20240102030405-05'30'": "2024-01-02T03:04:05-05:30", "D:202401020304": "2024-01-02T03:04:00Z", "yesterday": "yesterday"}
    assert one(spark, *[strings.date_to_iso(F.lit(k)) for k in cases]) == tuple(cases.values())


def test_numerals_and_labels(spark):
    assert one(spark, *[strings.roman(F.lit(n)) for n in (1, 4, 9, 40, 1994, 3999)]) == ("I", "IV", "IX", "XL", "MCMXCIV", "MMMCMXCIX")
    assert one(spark, *[strings.letters(F.lit(n)) for n in (1, 26, 27, 53)]) == ("A", "Z", "AA", "AAA")


def test_text_strings(spark):
    assert one(spark, strings.text_string(F.lit(b"\xfe\xff\x00a\x20\xac")), strings.text_string(F.lit("é".encode())), strings.text_string(F.lit(b"a\xff"))) == ("a€", "é", "a�")


def test_hyphens_in_chains(spark):
    join = lambda *rows: one(spark, strings.join_hyphens(F.array(*[F.lit(r) for r in rows])))
    assert join("a-", "b-", "c d") == ["abc", "d"]
    assert join("the speci-", "fied below") == ["the specified", "below"]
    assert join("x-", "Upper") == ["x-", "Upper"] and join("1-", "b") == ["1-", "b"]


def test_bidi(spark):
    assert one(spark, strings.reorder_bidi(F.lit("plain (a) 1"))) == "plain (a) 1"
    assert one(spark, strings.reorder_bidi(F.lit("םולש 12"))) == "12 שלום"
    assert one(spark, strings.reorder_bidi(F.lit("say םולש now"))) == "say שלום now"


def test_colours(spark):
    near = lambda c, want: all(abs(a - b) <= 1 for a, b in zip(c, want))
    assert tuple(one(spark, colour.cmyk(F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(0.0)))) == (255, 0, 128)
    white = (0.9505, 1.0, 1.089)
    assert near(one(spark, colour.lab(F.lit(100.0), F.lit(0.0), F.lit(0.0), white)), (255, 255, 255))
    assert near(one(spark, colour.cal_gray(F.lit(0.0), white)), (0, 0, 0))
    assert bytes(one(spark, colour.indexed(F.lit(bytes(range(12))), F.lit(9.0), 3))) == bytes([9, 10, 11])
    parts = [lambda x: x * 2, lambda x: x + 10]
    assert one(spark, *[colour.stitched(F.lit(v), (0.0, 1.0), [0.5], [0, 1, 0, 1], parts) for v in (0.25, 0.5, 1.0)]) == (1.0, 10.0, 11.0)
    assert one(spark, colour.sampled(F.lit(0.25), [0, 1, 4], (0.0, 1.0))) == 0.5


def test_calculator(spark):
    run = lambda source, *x, out=((-1000, 1000),): one(spark, calculator.calculator(source, [F.lit(float(v)) for v in x], [-1000, 1000] * len(x), [b for o in out for b in o]))
    assert run("{ 3 1 roll add mul }", 2, 3, 4) == [20.0]
    assert run("{ 2 copy add 3 1 roll pop pop }", 2, 3) == [5.0]
    assert run("{ 7 3 idiv exch pop }", 0) == [2.0] and run("{ 1 atan }", 1) == [45.0]
    assert run("{ dup 0 lt { neg } if }", -4) == [4.0]
    assert run("{ 0 div }", 1) == [0.0] and run("{ nosuch }", 1) == [0.0]
    assert math.isclose(run("{ sqrt 2 exp }", 3)[0], 3.0)


def test_rc4_and_keys(spark):
    assert bytes(one(spark, crypto.rc4(F.lit(b"Key"), F.lit(b"Plaintext")))).hex() == "bbf316e8d940af0ad3"
    assert bytes(one(spark, crypto.little_endian(F.lit(-44), 4))) == (2**32 - 44).to_bytes(4, "little")
    assert one(spark, crypto.signed_bytes(F.lit(b"abcdef"), F.array(*[F.lit(x) for x in (0, 2, 1, 2)]))) is None
    import hashlib

    key = hashlib.md5(crypto.PADDING + bytes(32) + (4).to_bytes(4, "little") + b"id").digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    assert bytes(one(spark, crypto.file_key(F.lit(b""), F.lit(bytes(32)), F.lit(4), F.lit(b"id"), 3, 16))) == key


def test_samples():
    assert samples.rgba(bytes([0b10110000]), 4, 1, 1, "DeviceGray")[::4] == bytes([255, 0, 255, 255])
    assert samples.rgba(bytes([0, 255, 0, 0]), 1, 1, 8, "DeviceCMYK") == bytes([255, 0, 255, 255])
    assert samples.rgba(bytes([0x12, 0x34]), 1, 1, 16, "DeviceGray") == bytes([0x12] * 3 + [255])
    assert samples.rgba(b"\x40", 1, 1, 2, "Indexed", palette=bytes(range(6))) == bytes([3, 4, 5, 255])
    assert samples.rgba(b"", 1, 1, 8, "Pattern") is None
    assert samples.resample(bytes(range(4)), 2, 2, 4, 4)[:4] == bytes([0, 0, 1, 1])
