"""Letter spacing, spans with a text of their own, accents, directions and widths of base fonts."""

import json
import random

from pyspark.sql import functions as F

from quirel.operators import fonts, reading
from quirel.operators import text as T
from quirel.sources import objects as O
from quirel.sources import writer as W

FONT = json.dumps({"subtype": "Type1", "encoding": "WinAnsiEncoding", "first": 32, "widths": [500] * 224})
RUN = "doc_id long, page_index int, page_obj long, " + T.RUN


def walked(content, properties=None):
    walker = T.Walker(T.Scope({"fonts": {"F": "1"}, "properties": properties or {}}, {1: fonts.Font(json.loads(FONT))}), lambda n: None)
    walker.run(content.encode("latin-1"))
    return walker.runs


def run(seq, text, x, y, size=10.0, width=None, tm=(1, 0, 0, 1), page=0):
    a, b, c, d = map(float, tm)
    width = 5.0 * len(text) if width is None else width
    return (1, page, 4, seq, text, float(x), float(y), "F", size, 0, 0.0, [a, b, c, d, float(x), float(y)], width * a, width * b, None, False)


def lines(spark, runs):
    found = T.run_lines(spark.createDataFrame(runs, RUN)).orderBy("page_index", "line_seq").collect()
    return [r.text for r in found]


def plain_spacing(singles, gaps):
    """The estimate by its rules, one at a time."""
    if len(singles) < 3 or 2 * sum(singles) < len(singles):
        return 0.0
    pairs = sorted(g for g, a, b in zip(gaps, singles, singles[1:]) if a and b)
    candidates = [g for g in pairs if 0.02 < g <= 0.3]
    if not pairs or pairs[(len(pairs) - 1) // 2] <= 0.02 or len(candidates) < 2:
        return 0.0
    shut = [g for g in gaps if g < candidates[0] / 2]
    return 0.0 if 5 * len(shut) > len(gaps) else candidates[0]


def test_spacing_of_lines_and_arrays_by_the_same_rules(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(400):
        n = rng.randint(1, 9)
        texts = [rng.choice("abc7") if rng.random() < 0.7 else rng.choice(["ab", ".", "é", "—"]) for _ in range(n)]
        gaps = [rng.choice([0.0, 0.01, 0.05, 0.1, 0.1, 0.2, 0.29, 0.31, 0.6, -0.1]) for _ in range(n - 1)]
        want[i] = plain_spacing([len(t) == 1 and t.isalnum() for t in texts], gaps)
        assert T.letter_spacing(texts, gaps) == want[i]
        rows.append((i, [{"text": t, "gap": g, "single": len(t) == 1 and t.isalnum()} for t, g in zip(texts, [None, *gaps])]))
    found = spark.createDataFrame(rows, "i int, p array<struct<text:string,gap:double,single:boolean>>").select("i", T.tracking(F.col("p")).alias("s")).collect()
    assert {r.i: r.s for r in found} == want and sum(v > 0 for v in want.values()) > 40


def test_arrays():
    assert walked("BT /F 10 Tf [(h) -100 (e) -100 (l) -100 (l) -100 (o) -400 (y) -100 (o) -100 (u)] TJ ET")[0]["text"] == "hello you"
    assert walked("BT /F 10 Tf [(he) -100 (l) 20 (lo) -200 (you)] TJ ET")[0]["text"] == "hello you"
    assert walked("BT /F 10 Tf 2 Tc [(spaced) -100 (out)] TJ ET")[0]["text"] == "spacedout"
    assert walked("BT /F 10 Tf 2 Tc [(spaced) -200 (out)] TJ ET")[0]["text"] == "spaced out"
    assert walked("BT /F 10 Tf [] TJ [100] TJ () Tj ET") == []


def test_lines_glyph_by_glyph(spark):
    tracked = [run(i, c, 50 + 7 * k, 700) for i, (k, c) in enumerate([(k, c) for k, c in enumerate("let us go") if c != " "])]
    plain = [run(100 + i, c, 50 + 5 * k, 600) for i, (k, c) in enumerate([(k, c) for k, c in enumerate("let us go") if c != " "])]
    assert lines(spark, tracked + plain) == ["let us go", "let us go"]
    assert lines(spark, [run(0, "let", 50, 700), run(1, "us", 67, 700), run(2, "go", 77, 700)]) == ["let usgo"]


def test_lines_drawn_twice_count_once(spark):
    line = [run(0, "bold", 50, 700), run(1, "face", 75, 700)]
    again = [run(2, "bold", 50.3, 700.2), run(3, "face", 75.3, 700.2)]
    other = [run(4, "bold", 50, 680), run(5, "face", 75, 680)]
    assert lines(spark, line + again + other) == ["bold face", "bold face"]
    assert lines(spark, [run(0, "x", 50, 700), run(1, "x", 50.5, 700), run(2, "x", 50, 700, page=1)]) == ["x", "x"]


def test_accents(spark):
    over = [run(0, "f", 50, 700), run(1, "¨", 55, 700), run(2, "unf", 55.5, 700), run(3, "´", 80, 600), run(4, "e", 80, 600), run(5, "´", 90, 500), run(6, "q", 90, 500), run(7, "¨", 50, 400), run(8, "u", 60, 400), run(9, "ˇ", 50, 300), run(10, "ıx", 50, 300)]
    assert lines(spark, over) == ["fünf", "é", "´q", "¨ u", "ǐx"]


def test_spans_with_a_text_of_their_own():
    found = walked("BT /F 10 Tf /S << /ActualText (whole) >> BDC (wh) Tj /T << /ActualText (in) /MCID 4 >> BDC (o) Tj EMC (le) Tj EMC (rest) Tj ET")
    assert [(r["text"], r["x"], round(r["adv_x"], 3), r["mcid"]) for r in found] == [("whole", 0.0, 25.0, None), ("in", 10.0, 5.0, 4), ("rest", 25.0, 20.0, None)]
    found = walked("/S /P BDC BT /F 10 Tf 0 2 -2 0 5 5 Tm (ab) Tj 0 0 Td (c) Tj ET EMC", {"P": json.dumps({"ActualText": {"s": "feff00e4"}})})
    assert [(r["text"], round(r["adv_x"], 3), round(r["adv_y"], 3)) for r in found] == [("ä", 0.0, 10.0)]
    assert [r["text"] for r in walked("BT /F 10 Tf /S << /ActualText () >> BDC (gone) Tj EMC (here) Tj ET")] == ["", "here"]


def test_directions(spark):
    up, level, mirrored = (0, 1, -1, 0), (1, 0, 0, 1), (1, 0, 0, -1)
    runs = [run(0, "side one", 300, 300, tm=up), run(1, "level one", 50, 700), run(2, "side two", 312, 300, tm=up), run(3, "level two is the longest", 50, 680, tm=level), run(4, "mirror", 50, 100, tm=mirrored), run(5, "below", 50, 120, tm=mirrored)]
    found = reading.layout_text(spark.createDataFrame(runs, RUN)).collect()
    assert [r.text for r in found] == ["level one\nlevel two is the longest\nside one\nside two\nmirror\nbelow"]
    keys = reading.segments(spark.createDataFrame(runs, RUN)).select("direction", "text").collect()
    assert {r.direction for r in keys if r.text.startswith("side")} == {90} and {r.direction for r in keys if r.text in ("mirror", "below")} == {360}


def test_widths_of_base_fonts_and_names_by_rule():
    font = fonts.Font({"subtype": "Type1", "base_font": "ABCDEF+Helvetica-Oblique", "encoding": "WinAnsiEncoding"})
    assert font.measure(b"Hi W\xe9") == (0.722 + 0.222 + 0.278 + 0.944 + 0.556, 5, 1)
    assert fonts.Font({"base_font": "TimesNewRoman,Bold"}).measure(b"a ")[0] == 0.444 + 0.25 and fonts.Font({"base_font": "Courier"}).measure(b"iW")[0] == 1.2
    assert fonts.Font({"base_font": "Own"}).measure(b"iW")[0] == 1.0 and fonts.Font({"base_font": "Helvetica", "first": 65, "widths": [100]}).measure(b"AB")[0] == 0.1 + 0.667
    assert [fonts.glyph_text(n) for n in ("omega", "Lambda", "afii10017", "afii10071", "afii10097", "afii10100", "beta1", "dieresis", "f_i.alt")] == ["ω", "Λ", "А", "ё", "я", None, None, "¨", "fi"]


def test_fonts_and_forms_are_sent_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)
    stream = lambda d, e="": f"<< /Length {len(d)} {e} >>\nstream\n{d}\nendstream"
    kids = " ".join(f"{100 + i} 0 R" for i in range(120))
    bodies = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count 120 /Resources << /Font << /F 3 0 R >> /XObject << /X 4 0 R >> >> >>", 3: "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"}
    bodies[4] = stream("BT /F 10 Tf 50 700 Td (letterhead) Tj ET " + " " * 100_000, "/Type /XObject /Subtype /Form")
    for i in range(120):
        bodies[100 + i] = f"<< /Type /Page /Parent 2 0 R /Contents {300 + i} 0 R >>"
        bodies[300 + i] = stream(f"/X Do BT /F 10 Tf 50 600 Td (page {i}) Tj ET")
    objects = O.read_objects(W.assemble(spark.createDataFrame([(1, n, b) for n, b in bodies.items()], "doc_id long, obj_num int, body string"))).checkpoint()
    sent = {(r.kind, r.block): (r.n, r.size) for r in T.page_inputs(objects).groupBy("kind", "block").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).alias("size")).collect()}
    assert {k[1] for k in sent} == {0, 1, 2} and all(sent[0, b] == (1, 0) and sent[2, b][0] == 1 for b in range(3))
    assert sum(n for _, n in sent.values()) < 4 * 100_100 and sum(n for (k, _), (n, _) in sent.items() if k == 3) == 120
    found = T.page_texts(T.run_lines(T.runs(objects))).orderBy("page_index").collect()
    assert [r.text for r in found] == [f"letterhead\npage {i}" for i in range(120)]
