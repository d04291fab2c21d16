"""Painted paths of pages: one row for each paint operator, with its path, colours, clip and matrix."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions import colour
from quirel.plans.stages import materialize
from quirel.sources.objects import PdfError, parse

from .catalogue import annotations
from .pages import follow, pages, ref
from .paints import NAMED, paint_colours, paint_scopes
from .shadings import hex_colour
from .text import FORM_DEPTH, _times, page_contents, resource_names

NODE = "node_id int, depth int, fill string, stroke string, even_odd boolean, line_width double, line_cap int, line_join int, miter double, dash array<double>, dash_phase double, path array<struct<op:string,p:array<double>>>, clip array<struct<op:string,p:array<double>>>, ctm array<double>"
#: What a walk notes by name, for the scope that gives it a meaning: graphics states in force, how many were when a part of the line state was set last, and colours.
NOTED = "states array<string>, set_after array<int>, fill_paint struct<space:string,values:array<double>,pattern:string>, stroke_paint struct<space:string,values:array<double>,pattern:string>"
#: What paint operators do (fill, stroke, even-odd, close first), and components of the device colours.
PAINT = {"f": (1, 0, 0, 0), "F": (1, 0, 0, 0), "f*": (1, 0, 1, 0), "S": (0, 1, 0, 0), "s": (0, 1, 0, 1), "B": (1, 1, 0, 0), "B*": (1, 1, 1, 0), "b": (1, 1, 0, 1), "b*": (1, 1, 1, 1), "n": (0, 0, 0, 0)}
COLOURS = {"g": (1, False), "G": (1, True), "rg": (3, False), "RG": (3, True), "k": (4, False), "K": (4, True)}
CURVES = {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4}


def _hex(values: list[float]) -> str:
    if len(values) == 4:
        values = [1 - min(1.0, c + values[3]) for c in values[:3]]
    values = values * 3 if len(values) == 1 else values
    return "#" + "".join(f"{int(min(max(v, 0.0), 1.0) * 255 + 0.5):02x}" for v in values)


#: Columns of the line state besides the width.
LINE = ("line_cap", "line_join", "miter", "dash", "dash_phase")
#: What graphics states and patterns add to a node, null where nothing sets it.
LOOK = ("fill_alpha", "stroke_alpha", "blend", "mask", "fill_pattern", "stroke_pattern")
#: The device spaces by the names that a colour-space operator may give them, with their first colours.
DEVICES = {"DeviceGray": "#000000", "G": "#000000", "DeviceRGB": "#000000", "RGB": "#000000", "DeviceCMYK": "#000000", "CMYK": "#000000"}
#: Stands for the colour or width of what paints a form, which its own content hasn't set.
INHERITED = "inherited"


def paint_nodes(content: bytes, form: bool = False) -> list[dict]:
    """The paint operators of a content stream, in order; the graphics state is walked once.

    Of a form, colours and widths that it doesn't set are INHERITED and null. An entry with `do` paints the named form there, in the state that the entry has.
    Colours of named spaces and patterns are NAMED and noted, names of graphics states are noted in order, each once; NOTED's columns hold both.
    """
    start = (INHERITED, *[None] * 5) if form else ("#000000", 1.0, 0, 10.0, [], 0.0)
    state = {"fill": start[0], "stroke": start[0], "width": start[1], "cap": start[2], "join": start[2], "miter": start[3], "dash": start[4], "phase": start[5], "ctm": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), "clip": None, "states": (), "set_after": (0, 0, 0, 0, 0), "spaces": (None, None), "paints": (None, None)}
    line = lambda s: {"line_cap": s["cap"], "line_join": s["join"], "miter": s["miter"], "dash": s["dash"], "dash_phase": s["phase"]}
    stack, path, clipping, out, args, at = [], [], False, [], [], 0

    def note_set(place: int) -> None:
        """A part of the line state is set: graphics states before it no longer count for that part."""
        state["set_after"] = tuple(len(state["states"]) if i == place else n for i, n in enumerate(state["set_after"]))

    def apply_state(name: str) -> None:
        """A graphics state comes into force, behind the others; an earlier use of it has nothing left to say."""
        if name in state["states"]:
            gone = state["states"].index(name)
            state["states"] = tuple(n for n in state["states"] if n != name)
            state["set_after"] = tuple(n - (n > gone) for n in state["set_after"])
        state["states"] = (*state["states"], name)

    def put(side: int, shown: str, space: str | None, paint: dict | None = None) -> None:
        """Colour, space and noted paint of the fill (0) or stroke (1)."""
        state["stroke" if side else "fill"] = shown
        for key, value in (("spaces", space), ("paints", paint)):
            state[key] = tuple(value if i == side else v for i, v in enumerate(state[key]))

    def noted(fill: bool = True, stroke: bool = True) -> dict:
        return {"states": list(state["states"]), "set_after": list(state["set_after"]), "fill_paint": state["paints"][0] if fill else None, "stroke_paint": state["paints"][1] if stroke else None}

    while True:
        try:
            value, at = parse(content, at)
        except PdfError:
            return out
        if not isinstance(value, bytes):
            args.append(value)
            continue
        op = value.decode("latin-1")
        n = [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
        names = [a["n"] for a in args if isinstance(a, dict) and "n" in a]
        if op == "q":
            stack.append(dict(state))
        elif op == "Q" and stack:
            state = stack.pop()
        elif op == "cm" and len(n) == 6:
            state["ctm"] = _times(tuple(n), state["ctm"])
        elif op == "w" and n:
            state["width"] = n[0]
            note_set(0)
        elif op in ("J", "j") and n and n[0] in (0, 1, 2):
            state["cap" if op == "J" else "join"] = int(n[0])
            note_set(1 if op == "J" else 2)
        elif op == "M" and n:
            state["miter"] = n[0]
            note_set(3)
        elif op == "d" and args and isinstance(args[0], list) and len(n) == 1:
            state["dash"], state["phase"] = [float(x) for x in args[0] if isinstance(x, (int, float)) and x >= 0], n[0]
            note_set(4)
        elif op == "gs" and names:
            apply_state(names[-1])
        elif op in COLOURS and len(n) == COLOURS[op][0]:
            put(int(COLOURS[op][1]), _hex(n), None)
        elif op in ("cs", "CS") and names:
            side, space = int(op == "CS"), names[-1]
            put(side, DEVICES.get(space, NAMED), None if space in DEVICES else space, None if space in DEVICES else {"space": space, "values": None, "pattern": None})
        elif op in ("sc", "scn", "SC", "SCN"):
            side = int(op[0] == "S")
            space = state["spaces"][side]
            if names or space:
                put(side, NAMED, space, {"space": space, "values": n or None, "pattern": names[-1] if names else None})
            elif len(n) in (1, 3, 4):
                put(side, _hex(n), None)
        elif op == "sh" and names:
            # A shading fills all that the clip leaves: a node without a path.
            out.append({"node_id": len(out), "do": None, "depth": len(stack), "fill": NAMED, "stroke": None, "even_odd": None, "line_width": state["width"], **line(state), "path": [], "clip": state["clip"], "ctm": list(state["ctm"]), **noted(stroke=False), "fill_paint": {"space": None, "values": None, "pattern": f"sh {names[-1]}"}})
        elif op in CURVES and len(n) == CURVES[op]:
            path.append({"op": op, "p": n})
        elif op == "re" and len(n) == 4:
            x, y, w, h = n
            path += [{"op": o, "p": p} for o, p in (("m", [x, y]), ("l", [x + w, y]), ("l", [x + w, y + h]), ("l", [x, y + h]), ("h", []))]
        elif op == "h":
            path.append({"op": "h", "p": []})
        elif op in ("W", "W*"):
            clipping = True
        elif op in PAINT:
            fill, stroke, even, close = PAINT[op]
            path = [*path, {"op": "h", "p": []}] if close and path else path
            if path and (fill or stroke):
                out.append({"node_id": len(out), "do": None, "depth": len(stack), "fill": state["fill"] if fill else None, "stroke": state["stroke"] if stroke else None, "even_odd": bool(even), "line_width": state["width"], **line(state), "path": path, "clip": state["clip"], "ctm": list(state["ctm"]), **noted(bool(fill), bool(stroke))})
            if clipping:
                state["clip"], clipping = path, False
            path = []
        elif op == "Do" and args and isinstance(args[-1], dict) and "n" in args[-1]:
            out.append({"node_id": len(out), "do": args[-1]["n"], "depth": len(stack), "fill": state["fill"], "stroke": state["stroke"], "even_odd": None, "line_width": state["width"], **line(state), "path": None, "clip": state["clip"], "ctm": list(state["ctm"]), **noted()})
        elif op == "BI":
            end = re.compile(rb"\sEI(?=\s|\Z)").search(content, at)
            at = end.end() if end else len(content)
        args = []


def _nodes(contents: DataFrame, form: bool) -> DataFrame:
    """(doc_id, source, node_id, do, depth, fill, …) of rows (doc_id, source, content): each content is walked once, however often it is painted."""
    steps = pa.list_(pa.struct([("op", pa.string()), ("p", pa.list_(pa.float64()))]))
    paint = pa.struct([("space", pa.string()), ("values", pa.list_(pa.float64())), ("pattern", pa.string())])
    arrow = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("do", pa.string()), ("node_id", pa.int32()), ("depth", pa.int32()), ("fill", pa.string()), ("stroke", pa.string()), ("even_odd", pa.bool_()), ("line_width", pa.float64()), ("line_cap", pa.int32()), ("line_join", pa.int32()), ("miter", pa.float64()), ("dash", pa.list_(pa.float64())), ("dash_phase", pa.float64()), ("path", steps), ("clip", steps), ("ctm", pa.list_(pa.float64())), ("states", pa.list_(pa.string())), ("set_after", pa.list_(pa.int32())), ("fill_paint", paint), ("stroke_paint", paint)])

    def walk(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = [{"doc_id": r["doc_id"], "source": r["source"], **n} for n in paint_nodes(r["content"].encode("latin-1"), form)]
                for at in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 2000], schema=arrow)

    return contents.select("doc_id", "source", "content").mapInArrow(walk, f"doc_id long, source long, do string, {NODE}, {NOTED}")


def looked_up(nodes: DataFrame, scopes: tuple[DataFrame, DataFrame]) -> DataFrame:
    """nodes (doc_id, scope, NODE, NOTED) with what their scope's names stand for (scopes: those of paint_scopes), NOTED's columns replaced by LOOK's.

    Of the graphics states in force the last one that sets a part counts, if that part wasn't set by an operator behind it. Named colours
    become #rrggbb; a space that can't be told has none, a pattern that of its values, if any. INHERITED stays. Each colour of a scope is computed once.
    """
    maps, spaces = scopes
    nodes = materialize(nodes.join(maps.withColumnsRenamed({"states": "known", "patterns": "numbered"}), ["doc_id", "scope"], "left"))
    sides = ("fill", "stroke")
    # The values beside a pattern's name are those of the pattern space's base.
    shows = {s: (F.col(s) == NAMED) & (F.col(f"{s}_paint.pattern").isNull() | F.col(f"{s}_paint.values").isNotNull()) for s in sides}
    word = lambda key, values: F.to_json(F.struct(key.alias("k"), values.alias("v")))
    used = [nodes.where(shows[s]).select("doc_id", "scope", F.col(f"{s}_paint.space").alias("key"), F.col(f"{s}_paint.values").alias("values")) for s in sides]
    colours = paint_colours(used[0].unionByName(used[1]).where("key is not null").distinct(), spaces)
    colours = materialize(colours.select("doc_id", "scope", word(F.col("key"), F.col("values")).alias("word"), "colour"))
    have = spaces.select("doc_id", "scope", F.col("key").alias("word"), F.lit(True).alias("has"))
    for s in sides:
        paint = F.col(f"{s}_paint")
        nodes = nodes.withColumn("word", F.when(shows[s], word(paint["space"], paint["values"]))).join(colours.withColumnRenamed("colour", f"{s}_colour"), ["doc_id", "scope", "word"], "left")
        nodes = nodes.withColumn("word", F.when(shows[s], paint["space"])).join(have.withColumnRenamed("has", f"{s}_has"), ["doc_id", "scope", "word"], "left").drop("word")
        # Values of a name that the scope hasn't got are taken for a device's by their number.
        guessed = F.when(F.col(f"{s}_has").isNull() & F.size(paint["values"]).isin(1, 3, 4), hex_colour(paint["values"], F.size(paint["values"])))
        pattern = F.when(F.col(s) == NAMED, F.try_element_at("numbered", paint["pattern"]))
        nodes = nodes.withColumns({f"{s}_pattern": pattern, s: F.when(F.col(s) == NAMED, F.when(shows[s], F.coalesce(f"{s}_colour", guessed))).otherwise(F.col(s))}).drop(f"{s}_colour", f"{s}_has")
    in_force = F.transform("states", lambda name: F.try_element_at("known", name))
    nodes = nodes.withColumn("in_force", in_force)

    def last(part: str, after: Column | int = 0) -> Column:
        behind = F.transform("in_force", lambda state, i: F.when(i >= after, state[part]))
        return F.try_element_at(F.filter(behind, lambda v: v.isNotNull()), F.lit(-1))

    parts = {"line_width": ("width", 0), "line_cap": ("cap", 1), "line_join": ("join", 2), "miter": ("miter", 3), "dash": ("dash", 4), "dash_phase": ("phase", 4)}
    named = {c: F.coalesce(last(part, F.get("set_after", F.lit(i))), c) for c, (part, i) in parts.items()}
    nodes = nodes.withColumns(named | {c: last(c) for c in ("fill_alpha", "stroke_alpha", "blend", "mask")})
    return materialize(nodes.drop("states", "set_after", "fill_paint", "stroke_paint", "known", "numbered", "in_force"))


def _settled() -> dict[str, Column]:
    """LOOK's columns where nothing is left to inherit: opaque, Normal, and no mask after one that ends it."""
    return {"fill_alpha": F.coalesce("fill_alpha", F.lit(1.0)), "stroke_alpha": F.coalesce("stroke_alpha", F.lit(1.0)), "blend": F.coalesce("blend", F.lit("Normal")), "mask": F.when(F.col("mask.kind") != "None", F.col("mask"))}


def scene_nodes(objects: DataFrame, mode: str = "lenient") -> DataFrame:
    """(doc_id, page_index, node_id, depth, fill, stroke, …, path, clip, ctm, fill_alpha, …) of the pages' own content, in paint order; the columns are NODE's and LOOK's."""
    leaves = materialize(pages(objects, mode))
    inputs = page_contents(objects, leaves).withColumn("source", F.col("page_index").cast("long"))
    own = looked_up(_nodes(inputs, False).where("do is null").withColumns({"page_index": F.col("source").cast("int"), "scope": -F.col("source") - 1}), paint_scopes(objects, leaves))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("node_id")) - 1
    return own.withColumns({"node_id": place.cast("int"), **_settled()}).select("doc_id", "page_index", *[c.split()[0] for c in NODE.split(", ")], *LOOK)


def _matrix(column: str) -> Column:
    """An array of six numbers as a matrix; anything else is the identity."""
    at = lambda i: F.when(F.size(column) == 6, F.get(column, F.lit(i))).otherwise(float(i in (0, 3)))
    return colour.matrix(*[at(i) for i in range(6)])


def _numbers(m: Column) -> Column:
    return F.array(*[m[k] for k in "abcdef"])


def _onto(box: Column, matrix: Column, rect: Column) -> Column:
    """The matrix that takes a form's box, through the form's own matrix, onto an annotation's rectangle; of an empty box, one that only moves."""
    corner = [colour.apply(matrix, F.get(box, i), F.get(box, j)) for i in (0, 2) for j in (1, 3)]
    x0, x1 = F.least(*[c["x"] for c in corner]), F.greatest(*[c["x"] for c in corner])
    y0, y1 = F.least(*[c["y"] for c in corner]), F.greatest(*[c["y"] for c in corner])
    left, right, low, high = F.least(F.get(rect, 0), F.get(rect, 2)), F.greatest(F.get(rect, 0), F.get(rect, 2)), F.least(F.get(rect, 1), F.get(rect, 3)), F.greatest(F.get(rect, 1), F.get(rect, 3))
    sx, sy = F.when(x1 > x0, (right - left) / (x1 - x0)).otherwise(1.0), F.when(y1 > y0, (high - low) / (y1 - y0)).otherwise(1.0)
    return colour.matrix(sx, F.lit(0.0), F.lit(0.0), sy, left - x0 * sx, low - y0 * sy)


def shown_appearances(objects: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, form, rect): the normal appearances of annotations that are neither hidden nor kept off the screen; one with states is that of AS."""
    found = annotations(objects).where((F.col("flags").bitwiseAND(F.lit(2 | 32)) == 0) & (F.size("rect") == 4) & F.coalesce(F.col("subtype") != "Popup", F.lit(True)))
    found = found.withColumns({"normal": F.try_variant_get("value", "$.AP.N", "variant"), "state": F.try_variant_get("value", "$.AS.n", "string")})
    states = follow(found.withColumn("held", F.col("normal")), objects, "held")
    by_state = F.try_element_at(F.try_variant_get("held", "$", "map<string,variant>"), F.col("state"))
    streams = objects.where("data is not null").select("doc_id", F.col("obj_num").alias("form"))
    form = F.coalesce(ref(by_state, "$"), ref(F.col("normal"), "$"))
    return states.select("doc_id", "page_index", "seq", form.alias("form"), "rect").join(streams, ["doc_id", "form"])


def spliced_nodes(objects: DataFrame, mode: str = "lenient", appearances: bool = True) -> DataFrame:
    """(doc_id, page_index, node_id, level, form, fill, stroke, even_odd, line_width, line_cap, line_join, miter, dash, dash_phase, path, clip, ctm, fill_alpha, stroke_alpha, blend, mask, fill_pattern, stroke_pattern) of whole pages, forms and appearances spliced in, in paint order.

    Forms come in level by level through joins: paint-order keys grow by an item, matrices are composed, and what a form's content hasn't set is what its painter
    has. A form that is open already isn't painted again within itself. Annotations' appearances follow the page's content in their order.
    """
    leaves = materialize(pages(objects, mode))
    names, _ = resource_names(objects, leaves)
    held = F.explode(F.from_json(F.get_json_object("names", "$.forms"), "map<string,string>"))
    names = materialize(names)
    named = materialize(names.select("doc_id", "scope", held.alias("do", "form")).select("doc_id", "scope", "do", F.col("form").cast("long").alias("form")))
    scopes = paint_scopes(objects, leaves)
    # A form that has resources of its own looks nothing up in its painter's.
    resources = (F.try_variant_get("value", "$.Subtype.n", "string") == "Form") & F.try_variant_get("value", "$.Resources", "variant").isNotNull()
    forms = objects.where("data is not null").where((F.try_variant_get("value", "$.Subtype.n", "string") == "Form") | F.try_variant_get("value", "$.BBox", "variant").isNotNull())
    forms = materialize(forms.select("doc_id", F.col("obj_num").alias("form"), F.try_variant_get("value", "$.Matrix", "array<double>").alias("matrix"), F.try_variant_get("value", "$.BBox", "array<double>").alias("box"), resources.alias("own"), F.decode("data", "ISO-8859-1").alias("content")))
    inside = materialize(_nodes(forms.withColumnRenamed("form", "source"), True).withColumnsRenamed({"source": "form"}))
    forms = forms.drop("content")

    page = _nodes(page_contents(objects, leaves).withColumn("source", F.col("page_index").cast("long")), False)
    keep = ["doc_id", "page_index", "order", "above", "scope", "level", "form", "do", "fill", "stroke", "even_odd", "line_width", *LINE, "path", "clip", "ctm", *LOOK]
    page = page.withColumn("scope", -F.col("source") - 1)
    front = looked_up(page, scopes).withColumns(_settled()).select("*", F.col("source").cast("int").alias("page_index"), F.array("node_id").alias("order"), F.array().cast("array<long>").alias("above"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("form")).select(keep)

    def painted(at: DataFrame) -> DataFrame:
        """The nodes of forms that rows (…, form, base) paint."""
        met = at.join(forms, ["doc_id", "form"]).withColumn("scope", F.when(F.col("own"), F.col("form")).otherwise(F.col("scope"))).drop("own", "matrix", "box")
        inherited = ("fill", "stroke", "line_width", *LINE, "clip", *LOOK)
        met = met.withColumnsRenamed({c: f"o_{c}" for c in inherited})
        got = looked_up(met.join(inside.drop("depth").withColumnsRenamed({"node_id": "n"}), ["doc_id", "form"]), scopes)
        colours = {c: F.when(F.col(c) == INHERITED, F.col(f"o_{c}")).otherwise(F.col(c)) for c in ("fill", "stroke")}
        patterns = {f"{c}_pattern": F.when(F.col(c) == INHERITED, F.col(f"o_{c}_pattern")).otherwise(F.col(f"{c}_pattern")) for c in ("fill", "stroke")}
        rest = {c: F.coalesce(c, f"o_{c}") for c in inherited if c not in colours and c not in patterns}
        rest["mask"] = F.when(F.col("mask").isNull(), F.col("o_mask")).when(F.col("mask.kind") != "None", F.col("mask"))
        ctm = _numbers(colour.compose(_matrix("ctm"), _matrix("base")))
        here = {"order": F.concat("order", F.array("n")), "above": F.concat("above", F.array("form")), "level": F.col("level") + 1, "ctm": ctm}
        return got.withColumns(colours | patterns | rest | here).select(keep)

    first = None
    if appearances:
        shown = shown_appearances(objects).join(forms.select("doc_id", "form", "matrix", "box"), ["doc_id", "form"]).where(F.size("box") == 4)
        # Matrices are computed before they are composed further: each is used many times in the next.
        shown = materialize(shown.select("doc_id", "page_index", "seq", "form", _numbers(_matrix("matrix")).alias("matrix"), "box", "rect"))
        shown = materialize(shown.withColumn("fit", _onto(F.col("box"), _matrix("matrix"), F.col("rect"))))
        base = _numbers(colour.compose(_matrix("matrix"), F.col("fit")))
        # Behind every operator of the page's own content.
        first = shown.select("doc_id", "page_index", F.array(F.lit(1 << 30) + F.col("seq")).alias("order"), F.array().cast("array<long>").alias("above"), (-F.col("page_index") - 1).cast("long").alias("scope"), F.lit(0).alias("level"), "form", F.lit("#000000").alias("fill"), F.lit("#000000").alias("stroke"), F.lit(1.0).alias("line_width"), F.lit(0).alias("line_cap"), F.lit(0).alias("line_join"), F.lit(10.0).alias("miter"), F.array().cast("array<double>").alias("dash"), F.lit(0.0).alias("dash_phase"), F.lit(None).cast(page.schema["clip"].dataType).alias("clip"), base.alias("base"), F.lit(1.0).alias("fill_alpha"), F.lit(1.0).alias("stroke_alpha"), F.lit("Normal").alias("blend"), *[F.lit(None).cast(front.schema[c].dataType).alias(c) for c in LOOK[3:]])
        first = materialize(first)
        front = front.unionByName(painted(first).select(keep))
    found = None
    for _ in range(FORM_DEPTH + 1):
        front = materialize(front)
        own = front.where("do is null")
        found = own if found is None else found.unionByName(own)
        calls = front.where("do is not null").drop("form").join(named, ["doc_id", "scope", "do"]).where(~F.array_contains("above", F.col("form")))
        calls = calls.join(forms.select("doc_id", "form", "matrix"), ["doc_id", "form"])
        calls = materialize(calls.withColumn("base", _numbers(colour.compose(_matrix("matrix"), _matrix("ctm")))).drop("matrix", "path", "even_odd", "do", "ctm"))
        if calls.isEmpty():
            break
        front = painted(calls).select(keep)
    place = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("order")) - 1
    return found.select("doc_id", "page_index", place.cast("int").alias("node_id"), "level", "form", "fill", "stroke", "even_odd", "line_width", *LINE, "path", "clip", "ctm", *LOOK)
