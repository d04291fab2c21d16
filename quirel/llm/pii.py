"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to theirs.

The field scores whole candidate segments (all their digits, separators, checks and
surroundings at once). A dynamic program over tokens, in which an entity has at most
MAX_TOKENS tokens, chooses boundaries and types together. Away from digits and at signs nothing can be an entity, so
the program runs over the islands around them, which gives what a run over the whole text would. Its time grows
with the length of the text, whatever that holds.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_texts, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of an entity of the field at most (an address has up to 64 + 1 + 255).
MAX_TOKENS, MAX_CHARS = 14, 320

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from their at signs so that long runs aren't tried at each character."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and then start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                spans.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                    spans.append(("phone", *m.span()))
    return spans


# ---- the field ----

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_SEED = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]")
_CUES = {"tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "server": "ip", "mail": "email", "email": "email", "contact": "email"}
_LONGEST_CUE = max(map(len, _CUES))
_INSIDE = frozenset("()[]{}.-+@_%/ ")


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "alnum" if c.isalnum() else "quote" if c in "\"'`" else c if c in ".,-@:=/+" else "mark"


def _bucket(n: int) -> str:
    return next((name for most, name in ((0, "0"), (3, "1-3"), (7, "4-7"), (9, "8-9"), (11, "10-11"), (15, "12-15"), (19, "16-19")) if n <= most), "20+")


def _features(s: str, left: str, right: str, cue: str) -> list[str]:
    """What a whole segment looks like; the field has a weight for each of these with each type."""
    digits = [c for c in s if "0" <= c <= "9"]
    letters = any(c.isalpha() for c in s)
    groups = re.findall(r"[0-9]+", s)
    found = ["any", f"digits {_bucket(len(digits))}", f"letters {letters}", f"left {left}", f"right {right}", f"cue {cue}", f"first {s[0] if not s[0].isalnum() else 'alnum'}", f"last {s[-1] if not s[-1].isalnum() else 'alnum'}"]
    if len(groups) > 1 and not letters:
        found.append("groups " + "-".join(str(min(len(g), 5)) for g in groups[:5]))
        found.append("separators " + "".join(sorted(set(s) - set("0123456789"))))
    if not letters and 13 <= len(digits) <= 19:
        found.append(f"luhn {luhn(''.join(digits))}")
    if len(groups) == 4 and re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}", s):
        found.append(f"quad {all(int(g) <= 255 for g in groups)}")
    if letters:
        whole = re.fullmatch(r"[\w.%+-]+ ?(?:@|[(\[] ?at ?[)\]]) ?[\w-]+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z][\w-]*)+", s)
        found.append(f"address {'no' if not whole else 'tail' if re.search(r'[A-Za-z]{2,}$', s) else 'yes'}")
    if s.count("(") != s.count(")") or s.count("[") != s.count("]"):
        found.append("unbalanced")
    return found


def _islands(text: str, blocked: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """Tokens (begin, end) and their cues around seeds outside blocked spans.

    No segment crosses a blocked span or a break between tokens, and each has a seed and at most MAX_TOKENS tokens: so
    what the program finds on the tokens near seeds of each unbroken run is what it finds on the whole text.
    """
    low = 0
    for begin, end in [*sorted(blocked), (len(text), len(text))]:
        if low < begin and _SEED.search(text, low, begin):
            yield from _runs(text, low, begin)
        low = max(low, end)


def _runs(text: str, low: int, high: int) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    seeds = [m.start() for m in _SEED.finditer(text, low, high)]
    cue, seed, last = "none", 0, low
    tokens: list[tuple[int, int]] = []
    cues: list[str] = []
    near: list[int] = []
    for m in _TOKEN.finditer(text, low, high):
        a, b = m.span()
        if tokens and (a - last > 1 or (a > last and text[last] != " ") or not (text[a].isalnum() or text[a] in _INSIDE)):
            if near:
                yield from _windows(tokens, cues, near)
            tokens, cues, near = [], [], []
        while seed < len(seeds) and seeds[seed] < b:
            if seeds[seed] >= a and near[-1:] != [len(tokens)]:
                near.append(len(tokens))
            seed += 1
        tokens.append((a, b))
        cues.append(cue)
        if b - a > 1:
            cue = _CUES.get(text[a:b].lower(), "none") if b - a <= _LONGEST_CUE else "none"
        last = b
    if near:
        yield from _windows(tokens, cues, near)


def _windows(tokens: list[tuple[int, int]], cues: list[str], near: list[int]) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """The parts of a run that segments with a seed can reach."""
    begin, end = max(0, near[0] - MAX_TOKENS + 1), near[0] + MAX_TOKENS
    for at in near[1:]:
        if at - MAX_TOKENS + 1 > end:
            yield tokens[begin:end], cues[begin:end]
            begin = at - MAX_TOKENS + 1
        end = at + MAX_TOKENS
    yield tokens[begin:end], cues[begin:end]


def _segments(text: str, tokens: list[tuple[int, int]], cues: list[str]) -> Iterator[tuple[int, int, tuple[str, str, str, str]]]:
    """Candidate segments of tokens without a break: (first token, behind the last, what features are made of).

    An entity without letters has 4 to 19 digits, one with letters has one at sign or written one; both end in
    a letter, a digit or a closing bracket.
    """
    digits, letters, ats = [0], [0], [0]
    for k, (a, b) in enumerate(tokens):
        s = text[a:b] if b - a <= MAX_CHARS else text[a : a + MAX_CHARS]
        digits.append(digits[-1] + len(_DIGIT.findall(s)))
        letters.append(letters[-1] + (not s.isdecimal() and s[0].isalnum()))
        at = s == "@" or (s.lower() == "at" and 0 < k and text[a - 1] in "([ " and b < len(text) and text[b] in ")] ")
        ats.append(ats[-1] + at)
    for i, (a, b) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            y = tokens[j][1]
            if y - a > MAX_CHARS or ats[j + 1] > ats[i] + 1:
                break
            if not (text[y - 1].isalnum() or text[y - 1] in ")]"):
                continue
            if ats[j + 1] > ats[i] if letters[j + 1] > letters[i] else 4 <= digits[j + 1] - digits[i] <= 19:
                if _SEED.search(text, a, y):
                    yield i, j + 1, (text[a:y], _side(text, a - 1), _side(text, y), cues[i])


def _example(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated window with its entities, some as the fixed patterns have them and some in other common forms."""
    word = lambda: "".join(rng.choice(("an", "re", "lo", "ti", "en", "sch", "ue", "da", "mo")) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(("", " ", "-", "."))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        user, host, top = rng.choice((word(), f"{word()}.{word()}", word() + num(2))), rng.choice((word(), word() + num(1))), rng.choice(("com", "org", "net", "de"))
        return f"{user}{rng.choice(('@', '@', ' (at) ', ' [at] ', '(at)'))}{host}{rng.choice(('.', '.', ' (dot) ', ' [dot] '))}{top}"

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)}-{a}-{b}{c}"))

    def ip() -> str:
        dot = rng.choice((".", ".", "[.]", "(.)"))
        return dot.join(str(rng.randint(0, 255)) for _ in range(4))

    def nothing() -> str:
        return rng.choice((
            lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(1900, 2030)}", lambda: f"{num(2)}.{num(2)}.{rng.randint(1990, 2030)}",
            lambda: f"{rng.randint(1990, 2030)}-{num(2)}-{num(2)}", lambda: f"{num(16)}", lambda: f"{num(rng.randint(1, 9))}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)},{num(2)}", lambda: f"@{word()}", lambda: f"{num(20)}", lambda: f"{word()}{num(3)}", lambda: f"{num(3)}.{num(3)}.{num(3)},{num(2)}",
            lambda: f"{rng.randint(256, 999)}.{num(3)}.{num(1)}.{num(2)}",
        ))()

    parts, spans = [word() for _ in range(rng.randint(0, 3))], []
    if rng.random() < 0.3:
        parts.append(rng.choice([*_CUES, "id", "no"]) + rng.choice(("", ":")))
    text = " ".join(parts)
    for _ in range(rng.randint(1, 2)):
        kind = rng.choice((*KINDS, "", ""))
        made = {"card": card, "email": email, "phone": phone, "ip": ip, "": nothing}[kind]()
        text += " " if text else ""
        if kind and not (kind == "card" and not luhn(re.sub(r"\D", "", made))):
            spans.append((kind, len(text), len(text) + len(made)))
        text += made + rng.choice(("", "", ".", ",", "!!", "%%%", "***")) + " " + word()
    return text, spans


@lru_cache(maxsize=4)
def trained(examples: int = 260, rounds: int = 40, seed: int = 20) -> dict[tuple[str, str], float]:
    """Weights by (type, feature): the field's penalised likelihood over generated windows, climbed with Adam."""
    rng = random.Random(seed)
    ids: dict[tuple[str, str], int] = {}
    windows, flat, begins = [], [], []
    gold_rows = []
    for _ in range(examples):
        text, spans = _example(rng)
        for tokens, cues in _islands(text, []):
            want = {(a, b): k for k, a, b in spans}
            arcs = []
            for i, j, made in _segments(text, tokens, cues):
                features = _features(*made)
                for kind in KINDS:
                    if want.get((tokens[i][0], tokens[j - 1][1])) == kind:
                        gold_rows.append(len(begins))
                    arcs.append((i, j, len(begins)))
                    begins.append(len(flat))
                    flat += [ids.setdefault((kind, f), len(ids)) for f in features]
            if arcs:
                windows.append((len(tokens), arcs))
    flat, begins = np.array(flat), np.array(begins)
    owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(flat))))
    gold = np.bincount(flat[np.isin(owner, gold_rows)], minlength=len(ids)).astype(float)
    w, m, v = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
    for step in range(1, rounds + 1):
        scores = np.add.reduceat(w[flat], begins).tolist()
        posterior = np.zeros(len(begins))
        for n, arcs in windows:
            _posterior(n, arcs, scores, posterior)
        slope = gold - np.bincount(flat, weights=posterior[owner], minlength=len(ids)) - 0.05 * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {k: float(w[i]) for k, i in ids.items()}


def _posterior(n: int, arcs: list[tuple[int, int, int]], scores: list[float], out: np.ndarray) -> None:
    """Probabilities of a window's segments by the forward and backward sums; a token outside entities scores 0."""
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    into, outof = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for i, j, k in arcs:
        into[j].append((i, scores[k]))
        outof[i].append((j, scores[k]))
    for t in range(1, n + 1):
        terms = [forward[t - 1], *(forward[i] + s for i, s in into[t])]
        top = max(terms)
        forward[t] = top + math.log(sum(math.exp(x - top) for x in terms))
    for t in range(n - 1, -1, -1):
        terms = [backward[t + 1], *(backward[j] + s for j, s in outof[t])]
        top = max(terms)
        backward[t] = top + math.log(sum(math.exp(x - top) for x in terms))
    for i, j, k in arcs:
        out[k] = math.exp(forward[i] + scores[k] + backward[j] - forward[n])


def best_type(weights: dict[tuple[str, str], float]) -> Callable[..., tuple[float, str]]:
    """The weight and type of the best type of a segment, remembered for segments that recur."""

    @lru_cache(maxsize=20_000)
    def one(*made: str) -> tuple[float, str]:
        features = _features(*made)
        return max((sum(weights.get((kind, f), 0.0) for f in features), kind) for kind in KINDS)

    return one


def field_spans(text: str, base: list[tuple[str, int, int]], score_of: Callable[..., tuple[float, str]]) -> list[tuple[str, int, int]]:
    """Entities of the best segmentation outside base spans."""
    found = []
    for tokens, cues in _islands(text, [(a, b) for _, a, b in base]):
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        arcs: dict[int, list] = {}
        for i, j, made in _segments(text, tokens, cues):
            score, kind = score_of(*made)
            if score > 0:
                arcs.setdefault(j, []).append((i, score, kind))
        if not arcs:
            continue
        for t in range(1, len(tokens) + 1):
            best[t], back[t] = best[t - 1], None
            for i, score, kind in arcs.get(t, ()):
                if best[i] + score > best[t]:
                    best[t], back[t] = best[i] + score, (i, kind)
        t = len(tokens)
        while t:
            if back[t] is None:
                t -= 1
            else:
                i, kind = back[t]
                found.append((kind, tokens[i][0], tokens[t - 1][1]))
                t = i
    return found


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and spans, an array of (kind, start, end, base), by kind as in KINDS, then start.

    Offsets are code points, end exclusive. base marks those of the fixed patterns, which
    always stay; the field adds others that don't overlap them, of at most MAX_TOKENS tokens and MAX_CHARS characters.
    Null and empty texts have no spans, very long ones are searched whole. Rows that repeat are treated
    alike, ids may be null or repeat; other columns are ignored, whatever their names. No rows give no rows.
    """
    weights = trained()
    place = {k: i for i, k in enumerate(KINDS)}
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("body"))

    def make():
        score_of = best_type(weights)

        def one(text: str) -> list[dict]:
            base = base_spans(text)
            spans = [(k, a, b, True) for k, a, b in base]
            if _SEED.search(text):
                spans += [(k, a, b, False) for k, a, b in field_spans(text, base, score_of)]
            spans.sort(key=lambda s: (place[s[0]], s[1], not s[3]))
            return [dict(zip(("kind", "start", "end", "base"), s)) for s in spans]

        return lambda texts: {"spans": [one(t) for t in texts]}

    found = map_texts(rows, "body", make, "spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    return found.withColumnRenamed("id", id_col)
