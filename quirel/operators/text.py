"""Positioned text runs of pages, and lines and texts made of them with windows."""

from __future__ import annotations

import json
import re
import string
import struct
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.plans.stages import materialize
from quirel.sources.objects import PdfError, parse

from .fonts import Font, fonts
from .pages import follow, pages

#: Fixed values, in em: gap of a word, shift and backtrack of a new line, overprint; and the walker's budgets.
WORD, SHIFT, BACKTRACK, OVERPRINT = 0.15, 0.5, 0.5, 0.1
FORM_DEPTH, MARKED_DEPTH = 8, 256
#: Fixed values, in em: gaps that are rounding only, and widest letter spacing.
NOISE, SPACING = 0.02, 0.3
#: Accents that stand for themselves, and the combining marks that they are over a letter.
SPACING_ACCENTS = {"`": "\u0300", "´": "\u0301", "ˆ": "\u0302", "˜": "\u0303", "¯": "\u0304", "˘": "\u0306", "˙": "\u0307", "¨": "\u0308", "˚": "\u030a", "¸": "\u0327", "˝": "\u030b", "˛": "\u0328", "ˇ": "\u030c"}

RUN = "run_seq int, text string, x float, y float, font_name string, font_size float, render_mode int, text_rise float, tm array<float>, adv_x float, adv_y float, mcid long, artifact boolean"


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o


_FLOAT = struct.Struct("f")


def _single(v: float) -> float:
    """v in single precision."""
    return _FLOAT.unpack(_FLOAT.pack(v))[0] if abs(v) < 3e38 else 0.0


def _text_of(digits: str) -> str:
    """A text string's text: UTF-16 behind its mark, else UTF-8 with broken parts replaced."""
    raw = bytes.fromhex(digits)
    return raw[2 : len(raw) - len(raw) % 2].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8", "replace")


class Scope:
    """The fonts, forms and property lists that names stand for in a page or a form."""

    def __init__(self, names: dict, fonts: dict[int, Font]):
        self.fonts = {k: fonts[int(n)] for k, n in (names.get("fonts") or {}).items() if int(n) in fonts}
        self.forms = {k: int(n) for k, n in (names.get("forms") or {}).items()}
        self.properties = {k: json.loads(v) for k, v in (names.get("properties") or {}).items()}


class Form(NamedTuple):
    matrix: tuple
    data: bytes
    scope: Scope | None


class Walker:
    """The text state of a content stream; sequential by nature, so a page is one pass."""

    def __init__(self, scope: Scope, form: Callable[[int], Form | None]):
        self.scope, self.form, self.painting = scope, form, []
        self.runs: list[dict] = []
        self.ctm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        self.state = {"font": None, "name": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0, "Tr": 0, "Ts": 0.0}
        self.tm = self.tlm = self.ctm
        self.open, self.stack, self.marks = False, [], []

    def run(self, data: bytes, depth: int = 0) -> None:
        at, args = 0, []
        while True:
            try:
                value, at = parse(data, at)
            except PdfError:
                return
            if isinstance(value, bytes):
                if value == b"BI":
                    end = re.compile(rb"\sEI(?=\s|\Z)").search(data, at)
                    at = end.end() if end else len(data)
                else:
                    self.do(value.decode("latin-1"), args, depth)
                args = []
            else:
                args.append(value)

    def do(self, op: str, args: list, depth: int) -> None:
        s = self.state
        number = lambda i, default=0.0: float(args[i]) if len(args) > i and isinstance(args[i], (int, float)) else default
        if op == "q":
            self.stack.append((self.ctm, self.tm, self.tlm, dict(s)))
        elif op == "Q" and self.stack:
            self.ctm, self.tm, self.tlm, self.state = self.stack.pop()
        elif op in ("cm", "Tm") and len(args) >= 6:
            m = tuple(number(i) for i in range(6))
            if op == "cm":
                self.ctm = _times(m, self.ctm)
            else:
                self.tm = self.tlm = m
        elif op == "BT":
            self.open, self.tm, self.tlm = True, (1.0, 0, 0, 1.0, 0, 0), (1.0, 0, 0, 1.0, 0, 0)
        elif op == "ET":
            self.open = False
        elif op == "Tf" and len(args) == 2:
            s["name"] = args[0].get("n") if isinstance(args[0], dict) else None
            s["font"], s["size"] = self.scope.fonts.get(s["name"]), number(1)
        elif op in ("Td", "TD"):
            if op == "TD":
                s["TL"] = -number(1)
            self.move(number(0), number(1))
        elif op == "T*":
            self.move(0, -s["TL"])
        elif op in ("Tc", "Tw", "TL", "Ts"):
            s[op] = number(0)
        elif op == "Tz":
            s["Tz"] = number(0, 100.0) / 100
        elif op == "Tr":
            s["Tr"] = int(number(0)) if 0 <= number(0) <= 7 else 0
        elif op == "Tj" and args:
            self.show(args[-1:])
        elif op == "TJ" and args and isinstance(args[-1], list):
            self.show(args[-1])
        elif op in ("'", '"') and args:
            if op == '"':
                s["Tw"], s["Tc"] = number(0), number(1)
            self.move(0, -s["TL"])
            self.show(args[-1:])
        elif op in ("BDC", "BMC") and len(self.marks) < MARKED_DEPTH:
            tag = args[0].get("n") if args and isinstance(args[0], dict) else None
            values = args[1] if len(args) > 1 else {}
            values = self.scope.properties.get(values["n"], {}) if isinstance(values, dict) and "n" in values else values
            mcid = values.get("MCID") if isinstance(values, dict) else None
            actual = values.get("ActualText") if isinstance(values, dict) else None
            span = {"text": _text_of(actual["s"]), "run": None} if isinstance(actual, dict) and "s" in actual else None
            above = self.marks[-1] if self.marks else (None, False, None)
            self.marks.append((mcid if isinstance(mcid, int) else above[0], above[1] or tag == "Artifact", span))
        elif op == "EMC" and self.marks:
            self.marks.pop()
        elif op == "Do" and args and isinstance(args[0], dict) and depth < FORM_DEPTH:
            number = self.scope.forms.get(args[0].get("n"))
            form = self.form(number) if number is not None else None
            if form and number not in self.painting:
                saved = self.ctm, dict(s), self.open, self.scope
                self.ctm, self.scope = _times(form.matrix, self.ctm), form.scope or self.scope
                self.painting.append(number)
                self.run(form.data, depth + 1)
                self.painting.pop()
                self.ctm, self.state, self.open, self.scope = saved

    def move(self, x: float, y: float) -> None:
        self.tm = self.tlm = _times((1, 0, 0, 1, x, y), self.tlm)

    def show(self, items: list) -> None:
        """One run of a show operator; gaps of an array become spaces from WORD and the array's letter spacing on, leading ones move the origin.

        Within a span that has a text of its own, the first show takes that text, and later ones only move its end.
        """
        s = self.state
        if not self.open or s["font"] is None:
            return
        font, pieces, gaps, moved, origin = s["font"], [], [], 0.0, None
        # Character spacing follows each glyph, the last of a string too.
        between = min(max(s["Tc"] / s["size"], -2.0), 2.0) if abs(s["size"]) > 1e-6 else 0.0
        gap = between
        for item in items:
            if isinstance(item, (int, float)):
                gap -= item / 1000
                moved -= item / 1000 * s["size"] * s["Tz"]
            elif isinstance(item, dict) and "s" in item:
                raw = bytes.fromhex(item["s"])
                if not raw:
                    continue
                if origin is None:
                    origin = moved
                else:
                    gaps.append(gap)
                gap = between
                width, n, spaces = font.measure(raw)
                moved += (width * s["size"] + n * s["Tc"] + spaces * s["Tw"]) * s["Tz"]
                pieces.append(font.decode(raw))
        full = _times(self.tm, self.ctm)
        self.tm = _times((1, 0, 0, 1, moved, 0), self.tm)
        text = pieces[0] if len(pieces) == 1 else _joined(pieces, gaps, between)
        span = next((m[2] for m in reversed(self.marks) if m[2]), None)
        if span and span["run"] is not None:
            # In the span's first run's own frame the end moves to where the pen is now.
            run, now = self.runs[span["run"]], _times(self.tm, self.ctm)
            a, b, c, d, e, f = run["tm"]
            x, y, det = now[4] - e, now[5] - f, a * d - b * c
            if abs(det) > 1e-9:
                along = (x * d - y * c) / det
                run["adv_x"], run["adv_y"] = _single(along * a), _single(along * b)
            return
        if span:
            text = span["text"]
        if (text or span) and origin is not None:
            f32 = _single
            run = moved - origin
            start = _times((1, 0, 0, 1, origin, s["Ts"]), full)
            mcid, artifact, _ = self.marks[-1] if self.marks else (None, False, None)
            if span:
                span["run"] = len(self.runs)
            self.runs.append({"run_seq": len(self.runs), "text": text, "x": f32(start[4]), "y": f32(start[5]), "font_name": s["name"], "font_size": f32(s["size"]), "render_mode": s["Tr"], "text_rise": f32(s["Ts"]), "tm": [f32(v) for v in start], "adv_x": f32(run * full[0]), "adv_y": f32(run * full[1]), "mcid": mcid, "artifact": artifact})


def letter_spacing(pieces: list[str], gaps: list[float]) -> float:
    """As tracking() over a line's runs, over the strings of one array: the gap, in em, that its glyphs were given, or 0."""
    single = [len(p) == 1 and p.isalnum() for p in pieces]
    if len(pieces) < 3 or sum(single) * 2 < len(pieces):
        return 0.0
    pairs = sorted(g for i, g in enumerate(gaps) if single[i] and single[i + 1])
    open_ = [g for g in pairs if NOISE < g <= SPACING]
    if not pairs or pairs[(len(pairs) - 1) // 2] <= NOISE or len(open_) < 2 or sum(g < 0.5 * open_[0] for g in gaps) * 5 > len(gaps):
        return 0.0
    return open_[0]


def _joined(pieces: list[str], gaps: list[float], between: float) -> str:
    """Strings of an array with spaces in their word gaps. Where most glyphs stand in longer strings, the character spacing is the line's."""
    spacing = letter_spacing(pieces, gaps)
    tracked = between > 0 and 2 * sum(len(p) for p in pieces if len(p) > 1) >= sum(map(len, pieces))
    spacing = max(spacing, between) if tracked else spacing
    # Else kerns take it back between single glyphs, and those of longer strings really stand apart.
    apart = not tracked and between >= WORD + spacing
    text = ""
    for i, piece in enumerate(pieces):
        if i and gaps[i - 1] >= WORD + spacing and text and not text.endswith(" "):
            text += " "
        text += re.sub(r"(?<=\S)(?=\S)", " ", piece) if apart else piece
    return text


def resource_entries(objects: DataFrame, leaves: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """(doc_id, scope, section, key, value): the entries of sections of resource dictionaries; these and their sections stand in place or are referred to."""
    stood = leaves.select("doc_id", (-F.col("page_index") - 1).cast("long").alias("scope"), F.try_parse_json("resources").alias("value"))
    of_forms = objects.where("data is not null").where(F.try_variant_get("value", "$.Subtype.n", "string") == "Form").select("doc_id", F.col("obj_num").alias("scope"), F.try_variant_get("value", "$.Resources", "variant").alias("value"))
    held = follow(stood.unionByName(of_forms).where("value is not null"), objects, "value")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.try_variant_get("value", f"$.{k}", "variant").alias("value")) for k in sections]))
    found = follow(held.select("doc_id", "scope", each.alias("s")).select("doc_id", "scope", "s.section", "s.value").where("value is not null"), objects, "value")
    return found.select("doc_id", "scope", "section", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("key", "value"))


def resource_names(objects: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, scope, names) of resource dictionaries, and (doc_id, obj_num, json) of all fonts.

    A scope is a page (minus its index less one) or a form (its object number). Dictionaries, their sections and entries stand in
    place or are referred to. names is JSON: fonts and forms by name as object numbers, properties as texts.
    """
    entries = materialize(resource_entries(objects, leaves, ("Font", "XObject", "Properties")).withColumn("obj_num", ref_of("value")))
    # A font that is no object gets a number of its own, below zero; equal ones of a document share it.
    inline = entries.where("section = 'Font' and obj_num is null").withColumn("obj_num", -1 - F.shiftrightunsigned(F.xxhash64("doc_id", F.to_json("value")), 1))
    found = fonts(objects, inline.select("doc_id", "obj_num", "value").dropDuplicates(["doc_id", "obj_num"])).select("doc_id", "obj_num", F.to_json("font").alias("json"))
    named = entries.where("section = 'Font' and obj_num is not null").unionByName(inline).select("doc_id", "scope", F.lit("fonts").alias("section"), "key", F.col("obj_num").cast("string").alias("json"))
    forms = entries.where("section = 'XObject' and obj_num is not null").select("doc_id", "scope", F.lit("forms").alias("section"), "key", F.col("obj_num").cast("string").alias("json"))
    properties = follow(entries.where("section = 'Properties'").select("doc_id", "scope", "key", "value"), objects, "value")
    properties = properties.select("doc_id", "scope", F.lit("properties").alias("section"), "key", F.to_json("value").alias("json"))
    of = lambda name: F.map_from_entries(F.collect_list(F.when(F.col("section") == name, F.struct("key", "json")))).alias(name)
    names = named.unionByName(forms).unionByName(properties).groupBy("doc_id", "scope").agg(of("fonts"), of("forms"), of("properties"))
    return names.select("doc_id", "scope", F.to_json(F.struct("fonts", "forms", "properties")).alias("names")), found


def page_contents(objects: DataFrame, leaves: DataFrame) -> DataFrame:
    """(doc_id, page_index, page_obj, content): each page's streams, one behind the other."""
    streams = objects.where("data is not null").select("doc_id", F.col("obj_num").alias("stream_num"), "data")
    bodies = leaves.select("doc_id", "page_index", "page_obj", F.posexplode("contents").alias("place", "stream_num")).join(streams, ["doc_id", "stream_num"])
    bodies = bodies.groupBy("doc_id", "page_index", "page_obj").agg(F.array_sort(F.collect_list(F.struct("place", F.decode("data", "ISO-8859-1").alias("t")))).alias("parts"))
    return bodies.select("doc_id", "page_index", "page_obj", F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("content"))


#: Pages that are walked by one task at least; a document's fonts and forms are sent once for each such block of it.
BLOCK = 512
#: Kinds of rows that a walk gets, in this order.
_FONT, _SCOPE, _FORM, _PAGE = range(4)


def page_inputs(objects: DataFrame, mode: str = "lenient") -> DataFrame:
    """(doc_id, block, kind, num, text, matrix, data, page_obj): what the walks of a block of pages need, in the order in which they need it.

    A block's fonts, names and forms come first, each once, and then its pages: nothing is copied to pages, and nothing is joined to them. A
    document of many pages is several blocks, so that several tasks share it.
    """
    leaves = materialize(pages(objects, mode))
    names, found = resource_names(objects, leaves)
    block = lambda index: F.floor(index / BLOCK).cast("int")
    none = {"text": F.lit(None).cast("string"), "matrix": F.lit(None).cast("array<double>"), "data": F.lit(None).cast("binary"), "page_obj": F.lit(None).cast("long")}
    shape = lambda rows, kind, num, **held: rows.select("doc_id", "block", F.lit(kind).alias("kind"), num.cast("long").alias("num"), *[held.get(c, none[c]).alias(c) for c in none])
    blocks = leaves.groupBy("doc_id").agg(F.max(block(F.col("page_index"))).alias("last"))
    each = lambda rows: rows.join(blocks, "doc_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    names = materialize(names)
    forms = objects.where("data is not null").where(F.try_variant_get("value", "$.Subtype.n", "string") == "Form")
    matrix = F.coalesce(F.try_variant_get("value", "$.Matrix", "array<double>"), F.array(*[F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)]))
    rows = [
        shape(each(found), _FONT, F.col("obj_num"), text=F.col("json")),
        shape(names.where("scope < 0").withColumn("block", block(-F.col("scope") - 1)), _SCOPE, F.col("scope"), text=F.col("names")),
        shape(each(names.where("scope > 0")), _SCOPE, F.col("scope"), text=F.col("names")),
        shape(each(forms.select("doc_id", "obj_num", matrix.alias("matrix"), "data")), _FORM, F.col("obj_num"), matrix=F.col("matrix"), data=F.col("data")),
        shape(page_contents(objects, leaves).withColumn("block", block(F.col("page_index"))), _PAGE, F.col("page_index"), text=F.col("content"), page_obj=F.col("page_obj")),
    ]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "kind")


def ref_of(column: str):
    return F.try_variant_get(column, "$.r[0]", "long")


class _Block:
    """What the pages of a block share."""

    def __init__(self, key: tuple):
        self.key, self.fonts, self.names, self.scopes, self.forms = key, {}, {}, {}, {}

    def scope(self, number: int) -> Scope | None:
        """The scope of a page or a form, made when it is first asked for; null for a form without resources."""
        if number not in self.scopes:
            self.scopes[number] = Scope(json.loads(self.names[number]), self.fonts) if number in self.names else None if number > 0 else Scope({}, {})
        return self.scopes[number]

    def form(self, number: int) -> Form | None:
        held = self.forms.get(number)
        if isinstance(held, tuple) and not isinstance(held, Form):
            held = self.forms[number] = Form(*held, self.scope(number))
        return held


def runs(objects: DataFrame, mode: str = "lenient") -> DataFrame:
    """(doc_id, page_index, page_obj, run_seq, text, x, y, …): text runs in paint order; a page's walk is its only Python."""
    inputs = page_inputs(objects, mode)
    schema = f"doc_id long, page_index int, page_obj long, {RUN}"
    names = [c.split()[0] for c in RUN.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.float32(), pa.float32(), pa.string(), pa.float32(), pa.int32(), pa.float32(), pa.list_(pa.float32()), pa.float32(), pa.float32(), pa.int64(), pa.bool_()]
    arrow = pa.schema(list(zip(["doc_id", "page_index", "page_obj", *names], types)))

    def walk(batches):
        known: dict[str, Font] = {}
        block, rows = _Block(()), []
        for batch in batches:
            if len(known) > 2000:
                known.clear()
            for r in batch.to_pylist():
                if block.key != (r["doc_id"], r["block"]):
                    block = _Block((r["doc_id"], r["block"]))
                kind, num = r["kind"], r["num"]
                if kind == _FONT:
                    block.fonts[num] = known.get(r["text"]) or known.setdefault(r["text"], Font(json.loads(r["text"])))
                elif kind == _SCOPE:
                    block.names[num] = r["text"]
                elif kind == _FORM:
                    block.forms[num] = tuple(r["matrix"]), r["data"]
                else:
                    walker = Walker(block.scope(-num - 1), block.form)
                    walker.run(r["text"].encode("latin-1"))
                    rows += [{"doc_id": r["doc_id"], "page_index": num, "page_obj": r["page_obj"], **run} for run in walker.runs]
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return inputs.mapInArrow(walk, schema)


def visible(found: DataFrame) -> DataFrame:
    """Runs that paint: neither invisible nor for clipping only."""
    return found.where(~F.col("render_mode").isin(3, 7))


def with_geometry(found: DataFrame) -> DataFrame:
    """em, the end of a run, its place along and across its own baseline, and its frame: where text goes on, where lines are stacked against, and
    the direction in whole degrees, with 360 more if the frame is mirrored."""
    em = F.abs(F.col("font_size")) * F.sqrt(F.get("tm", 2) ** 2 + F.get("tm", 3) ** 2)
    size, high = F.sqrt(F.get("tm", 0) ** 2 + F.get("tm", 1) ** 2), F.sqrt(F.get("tm", 2) ** 2 + F.get("tm", 3) ** 2)
    ux, uy = F.when(size > 0, F.get("tm", 0) / size).otherwise(1.0), F.when(size > 0, F.get("tm", 1) / size).otherwise(0.0)
    # A negative size turns glyphs over.
    turn = F.when(F.col("font_size") < 0, -1.0).otherwise(1.0)
    vx, vy = F.when(high > 0, turn * F.get("tm", 2) / high).otherwise(-uy), F.when(high > 0, turn * F.get("tm", 3) / high).otherwise(ux)
    degrees = F.pmod(F.round(F.degrees(F.atan2(uy, ux))).cast("int"), F.lit(360))
    direction = degrees + F.when(ux * vy - uy * vx < 0, 360).otherwise(0)
    return found.withColumns({"em": em, "ux": ux, "uy": uy, "along": F.col("x") * ux + F.col("y") * uy, "across": F.col("y") * ux - F.col("x") * uy, "end_along": (F.col("x") + F.col("adv_x")) * ux + (F.col("y") + F.col("adv_y")) * uy, "frame": F.struct(ux.alias("ux"), uy.alias("uy"), vx.alias("vx"), vy.alias("vy"), direction.alias("direction"))})


def _composed_letters() -> dict[str, str]:
    """Letters with an accent, by the accent's spacing character and the letter, as Unicode composes them."""
    letters = string.ascii_letters + "ıȷ"
    base = {"ı": "i", "ȷ": "j"}
    made = {a + c: unicodedata.normalize("NFC", base.get(c, c) + mark) for a, mark in SPACING_ACCENTS.items() for c in letters}
    return {k: v for k, v in made.items() if len(v) == 1}


def with_neighbours(found: DataFrame) -> DataFrame:
    """Runs that show something, in geometry, with what lies between each and the one before it on its page.

    gap and shift are along and across the former's baseline, em_big and em_small the pair's larger and smaller em; a show that repeats the former one
    in place is left out. `composed` is the first letter under a spacing accent which the former run is, where the two overlap; `eaten` marks that accent.
    """
    page = Window.partitionBy("doc_id", "page_index").orderBy("run_seq")
    kept = with_geometry(found.where(F.trim("text") != ""))
    same = (F.lag("text").over(page) == F.col("text")) & (F.abs(F.col("along") - F.lag("along").over(page)) <= OVERPRINT * F.col("em")) & (F.abs(F.col("across") - F.lag("across").over(page)) <= OVERPRINT * F.col("em"))
    kept = kept.withColumn("over", F.coalesce(same, F.lit(False))).where("not over")
    kept = kept.withColumns({"gap": F.col("along") - F.lag("end_along").over(page), "shift": F.col("across") - F.lag("across").over(page), "last_em": F.lag("em").over(page), "last_text": F.lag("text").over(page), "last_width": F.lag(F.col("end_along") - F.col("along")).over(page)})
    big = F.greatest("em", "last_em", F.lit(1e-3))
    kept = kept.withColumns({"em_big": big, "em_small": F.when((F.col("em") > 0) & (F.col("last_em") > 0), F.least("em", "last_em")).otherwise(big)})
    accent = F.col("last_text").isin(*SPACING_ACCENTS)
    table = F.create_map(*[F.lit(x) for pair in _composed_letters().items() for x in pair])
    on_it = accent & (F.col("gap") < 0) & (F.col("gap") >= -(F.col("last_width") + BACKTRACK * F.col("em_big"))) & (F.abs("shift") <= SHIFT * F.col("em_big"))
    kept = kept.withColumn("composed", F.when(on_it, F.try_element_at(table, F.concat("last_text", F.substring("text", 1, 1)))))
    return kept.withColumn("eaten", F.lead("composed").over(page).isNotNull())


def starts_line() -> Column:
    """Whether a run of with_neighbours begins a line: the baseline shifts, or the pen goes back (further, behind an accent: by its width too)."""
    back = F.when(F.col("last_text").isin(*SPACING_ACCENTS), F.col("last_width")).otherwise(0.0)
    return F.col("last_em").isNull() | (F.abs("shift") > SHIFT * F.col("em_big")) | (F.col("gap") < -(back + BACKTRACK * F.col("em_big")))


def piece() -> Column:
    """Aggregated by line, what tracking() and spaced_text() need of a run of with_neighbours."""
    relative = F.when(F.col("em_small") > 0, F.col("gap") / F.col("em_small")).otherwise(0.0)
    shown = F.when(F.col("eaten"), "").when(F.col("composed").isNotNull(), F.concat("composed", F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    closed = F.col("composed").isNotNull() | F.coalesce(F.col("last_text").rlike(r"\s$"), F.lit(False)) | F.col("text").rlike(r"^\s")
    return F.struct("run_seq", shown.alias("text"), relative.alias("gap"), F.col("text").rlike(r"^[\p{IsAlphabetic}\p{N}]$").alias("single"), closed.alias("closed"))


def tracking(pieces: Column) -> Column:
    """Letter spacing, in em, of a line's pieces in order: order statistics of the gaps between neighbours.

    Where at least half of three or more pieces are single glyphs, and the lower median of the gaps between such ones is past rounding, the least gap that may be
    spacing is what every glyph got; but not if more than a fifth of all gaps are closed to half of it.
    """
    n = F.size(pieces)
    gaps = F.transform(F.slice(pieces, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, i: F.struct(p["gap"].alias("gap"), (p["single"] & F.get(pieces, i)["single"]).alias("both")))
    pairs = F.array_sort(F.transform(F.filter(gaps, lambda g: g["both"]), lambda g: g["gap"]))
    typical = F.get(pairs, F.floor((F.size(pairs) - 1) / 2).cast("int"))
    open_ = F.filter(pairs, lambda g: (g > NOISE) & (g <= SPACING))
    spacing = F.get(open_, F.lit(0))
    shut = F.size(F.filter(gaps, lambda g: g["gap"] < 0.5 * spacing))
    lone = F.size(F.filter(pieces, lambda p: p["single"]))
    return F.when((n >= 3) & (lone * 2 >= n) & (F.size(pairs) > 0) & (typical > NOISE) & (F.size(open_) >= 2) & (shut * 5 <= n - 1), spacing).otherwise(0.0)


def spaced_text(pieces: str, spacing: str) -> Column:
    """A line's text: a space where a gap is wider than a word's and the line's own spacing together."""
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when((i > 0) & ~p["closed"] & (p["gap"] >= WORD + F.col(spacing)), " ").otherwise(""), p["text"])), "")


def run_lines(found: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_seq, text, y, em, runs): runs in paint order fall into lines where the baseline shifts or the pen goes back.

    Gaps and islands: lag, a running sum and an ordered concatenation; pages are the windows' partitions. A line that repeats the one before it run by run, in
    place, is left out.
    """
    page = Window.partitionBy("doc_id", "page_index").orderBy("run_seq")
    kept = with_neighbours(found).withColumn("line_seq", F.sum(starts_line().cast("int")).over(page) - 1)
    places = F.array_sort(F.collect_list(F.struct("run_seq", "text", "along", "across", "em")))
    grouped = kept.groupBy("doc_id", "page_index", "line_seq").agg(F.array_sort(F.collect_list(piece())).alias("pieces"), F.min_by("across", "run_seq").alias("y"), F.max("em").alias("em"), places.alias("places"))
    last = F.lag("places").over(Window.partitionBy("doc_id", "page_index").orderBy("line_seq"))
    near = lambda a, b, c, d: F.abs(a - b) <= OVERPRINT * F.greatest(c, d, F.lit(1e-3))
    again = lambda p, q: F.coalesce((p["text"] == q["text"]) & near(p["along"], q["along"], p["em"], q["em"]) & near(p["across"], q["across"], p["em"], q["em"]), F.lit(False))
    grouped = grouped.withColumn("over", F.coalesce((F.size(last) == F.size("places")) & F.forall(F.zip_with(last, F.col("places"), again), lambda x: x), F.lit(False))).where("not over")
    grouped = grouped.withColumn("line_seq", (F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("line_seq")) - 1).cast("long"))
    grouped = grouped.withColumn("spacing", tracking(F.col("pieces")))
    return grouped.select("doc_id", "page_index", "line_seq", F.rtrim(spaced_text("pieces", "spacing")).alias("text"), "y", "em", F.size("pieces").alias("runs"))


def page_texts(lines: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, page_index, lines, text): a page's lines in their order."""
    grouped = lines.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("line_seq", "text"))).alias("all"))
    return grouped.select("doc_id", "page_index", F.size("all").alias("lines"), F.array_join(F.transform("all", lambda x: x["text"]), separator).alias("text"))


def document_texts(page_text: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, pages, lines, text): pages with text in their order."""
    grouped = page_text.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("all"), F.sum("lines").alias("lines"))
    return grouped.select("doc_id", F.size("all").cast("long").alias("pages"), "lines", F.array_join(F.transform("all", lambda x: x["text"]), separator).alias("text"))
