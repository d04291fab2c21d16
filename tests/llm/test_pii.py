import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from quirel.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = ["", "1.2.3.4.5.6.7.8", "a@b@c.d e@f.g.h@i.j", "..@a.b", "1.2.3.999 1.2.3.0004", "9" * 5000, "+1" + " " * 2000, "@@a@b.c", "4" * 15 + " 4-4 4", "é+49 30 1234567 x", "a@b.c@d.e"]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_equals_plain_patterns(spark, sf_dir):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("0123456789. +-()@ab") for _ in range(400)) for _ in range(300)]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_pii(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        joined = [":".join(map(str, s)) for s in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in want) for k in PATTERNS]
        assert set(joined) <= set(r.spans.split(","))


def test_field_on_held_out_windows():
    score_of, rng = pii.best_type(pii.trained()), random.Random(4242)
    right = wrong = missed = 0
    for _ in range(400):
        text, gold = pii._example(rng)
        found = set(pii.field_spans(text, [], score_of))
        right, wrong, missed = right + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.9


def test_field_adds_other_forms_and_keeps_base(spark):
    docs = spark.createDataFrame([(1, "call (616) 555-3963 or mail a.b@c.de today"), (1, None), (None, ""), (2, "x " * 60_000 + "call 616-555-3963 now")], "doc_id long, text string").withColumn("spans", F.lit(3))
    rows = {(r.doc_id, i): r.spans for i, r in enumerate(pii.find_personal(docs).collect())}
    assert len(rows) == 4
    found = [[(s.kind, s.base) for s in v] for v in rows.values()]
    assert found[0] == [("email", True), ("phone", False)] and found[1] == found[2] == [] and found[3] == [("phone", False)]
    assert pii.find_personal(docs.where("false")).collect() == []


def whole_text_program(text, base, score_of):
    """The field's spans by one program over all tokens of each stretch between base spans."""
    found, low = [], 0
    for begin, end in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:
        tokens = [m.span() for m in pii._TOKEN.finditer(text, low, begin)] if low < begin else []
        low = max(low, end)
        cues, cue = [], "none"
        for a, b in tokens:
            cues.append(cue)
            cue = cue if b - a == 1 else pii._CUES.get(text[a:b].lower(), "none")
        joined = [True] + [text[b:a] in ("", " ") and (text[a].isalnum() or text[a] in pii._INSIDE) for (_, b), (a, _) in zip(tokens, tokens[1:])]
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for t in range(1, len(tokens) + 1):
            best[t] = best[t - 1]
            for i in range(max(0, t - pii.MAX_TOKENS), t):
                if all(joined[i + 1 : t]):
                    for x, y, made in pii._segments(text, tokens[i:t], cues[i:t]):
                        if (x, y) == (0, t - i):
                            score, kind = score_of(*made)
                            if score > 0 and best[i] + score > best[t]:
                                best[t], back[t] = best[i] + score, (i, kind)
        t = len(tokens)
        while t:
            if back[t]:
                found.append((back[t][1], tokens[back[t][0]][0], tokens[t - 1][1]))
            t = back[t][0] if back[t] else t - 1
    return found


def test_islands_equal_whole_text():
    score_of, rng = pii.best_type(pii.trained()), random.Random(77)
    parts = ["call ", "tel: ", "555-123-4567", "(616) 555 3963", "+49 30 1234567", "10[.]0[.]0[.]1", "ann (at) example (dot) org", "a.b@c", "word", ", ", ". ", " ", "\n", "x9", "(", ") ", "2021-03-04", "1.2.3.4", "/", "at "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(40))
        base = pii.base_spans(text)
        assert sorted(pii.field_spans(text, base, score_of)) == sorted(whole_text_program(text, base, score_of)), text


def test_time_grows_with_the_text_alone():
    score_of, rng = pii.best_type(pii.trained()), random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hard = ["a1b2" * 250_000, "".join(rng.choice(letters + "+/=") for _ in range(1_000_000)), "." * 1_000_000 + "1", "@" * 1_000_000, "a@" * 500_000, "1" * 1_000_000]
    for text in hard:
        began = time.process_time()
        pii.field_spans(text, pii.base_spans(text), score_of)
        assert time.process_time() - began < 20, text[:20]
