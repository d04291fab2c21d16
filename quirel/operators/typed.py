"""Annotations and actions with columns for what each kind of them holds, by column functions and a few joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirel.functions.strings import date_to_iso, text_string, variant_text
from quirel.plans.stages import materialize

from .catalogue import action_rows, annotations, destination, form_fields, named_destinations
from .pages import follow, pages, ref

#: Annotation subtypes by family; any other subtype is of the family "other".
FAMILIES = {
    "note": ("Text",),
    "free text": ("FreeText",),
    "stamp": ("Stamp",),
    "markup": ("Highlight", "Underline", "Squiggly", "StrikeOut"),
    "geometry": ("Square", "Circle"),
    "link": ("Link",),
    "widget": ("Widget",),
    "line": ("Line",),
    "polygon": ("Polygon", "PolyLine"),
    "ink": ("Ink",),
    "caret": ("Caret",),
    "popup": ("Popup",),
    "watermark": ("Watermark",),
    "redaction": ("Redact",),
    "file": ("FileAttachment",),
    "media": ("Sound", "Movie", "Screen", "3D", "RichMedia"),
    "printing": ("PrinterMark", "TrapNet"),
}
#: Annotation flags from the lowest bit on.
FLAGS = ("invisible", "hidden", "print", "no zoom", "no rotate", "no view", "read only", "locked", "toggle no view", "locked contents")
#: Icons of annotations that name none.
ICONS = {"note": "Note", "stamp": "Draft", "file": "PushPin"}
#: Formats of a submitted form by flag, the first that is set; without one it is FDF.
FORMATS = {4: "HTML", 32: "XFDF", 256: "PDF"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _variants(value: Column | str, path: str) -> Column:
    """The items of an array, none of anything else."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def file_name(value: str, path: str) -> Column:
    """The name that a file specification holds: a text, or a dictionary's Unicode name before its plain one."""
    return F.coalesce(*[variant_text(F.col(value), f"{path}{k}") for k in (".UF", ".F", ".Unix", ".DOS", ".Mac", "")])


def flag_names(flags: Column) -> Column:
    """Names of the flags that are set, from the lowest on."""
    return F.array_compact(F.array(*[F.when(flags.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(FLAGS)]))


def typed_annotations(objects: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Annotations of all pages, a row each: common columns, and columns of its family, null for others.

    Common: doc_id, page_index, seq, obj_num, subtype, family, rect, contents, name, modified, flags (names), colour, border, author, subject, created, opacity,
    popup, reply_to (object numbers), intent, layer. By family: icon, open, state, state_model (notes), appearance, quadding, rich (free texts), quads (markup, links, redactions),
    interior, insets (geometry, carets), field_kind, field_name, field_value (widgets: those of the fields above where they have none), ends, endings, caption (lines),
    vertices (polygons), strokes (ink), symbol (carets), parent (popups), overlay (redactions), file (files, media). Unknown subtypes are of the
    family "other"; entries of a wrong type are null.
    """
    found = annotations(objects, leaves)
    family = F.coalesce(F.try_element_at(_map({s: f for f, names in FAMILIES.items() for s in names}), F.col("subtype")), F.lit("other"))
    found = found.withColumn("family", family)
    is_ = lambda *names: F.col("family").isin(*names)
    get = lambda k, kind: F.try_variant_get("value", f"$.{k}", kind)
    text = lambda k: variant_text(F.col("value"), f"$.{k}")
    numbers = lambda k: get(k, "array<double>")
    only = lambda column, *names: F.when(is_(*names), column)

    # Files may stand in objects of their own; only annotations that have one take part in the join.
    at = ["doc_id", "page_index", "seq"]
    files = follow(found.where(is_("file", "media")).select(*at, F.coalesce(get("FS", "variant"), get("Movie.F", "variant"), get("Sound.F", "variant")).alias("spec")).where("spec is not null"), objects, "spec")
    files = files.select(*at, file_name("spec", "$").alias("file"))
    fields = form_fields(objects).where("field_num is not null").select("doc_id", F.col("field_num").alias("obj_num"), "full_name", "kind", "held").dropDuplicates(["doc_id", "obj_num"])
    found = found.join(files, at, "left").join(fields, ["doc_id", "obj_num"], "left")
    held = F.coalesce("held", get("V", "variant"))
    value = F.coalesce(text_string(F.unhex(F.try_variant_get(held, "$.s", "string"))), F.try_variant_get(held, "$.n", "string"), F.when(ref(held, "$").isNull() & F.try_variant_get(held, "$", "double").isNotNull(), F.try_variant_get(held, "$", "string")))

    columns = {
        "flags": flag_names(F.col("flags")),
        "colour": numbers("C"),
        "border": F.coalesce(get("BS.W", "double"), F.get(numbers("Border"), F.lit(2)), F.lit(1.0)),
        "author": F.when(~is_("widget"), text("T")),
        "subject": text("Subj"),
        "created": date_to_iso(text("CreationDate")),
        "opacity": F.coalesce(get("CA", "double"), F.lit(1.0)),
        "popup": ref(F.col("value"), "$.Popup"),
        "reply_to": ref(F.col("value"), "$.IRT"),
        "intent": get("IT.n", "string"),
        "layer": ref(F.col("value"), "$.OC"),
        "icon": F.when(is_(*ICONS), F.coalesce(get("Name.n", "string"), F.try_element_at(_map(ICONS), F.col("family")))),
        "open": only(F.coalesce(get("Open", "boolean"), F.lit(False)), "note", "popup"),
        "state": only(text("State"), "note"),
        "state_model": only(text("StateModel"), "note"),
        "appearance": only(text("DA"), "free text", "widget", "redaction"),
        "quadding": only(F.coalesce(get("Q", "int"), F.lit(0)), "free text", "redaction"),
        "rich": text("RC"),
        "quads": only(numbers("QuadPoints"), "markup", "link", "redaction"),
        "interior": only(numbers("IC"), "geometry", "line", "polygon", "redaction"),
        "insets": only(F.when(F.size(numbers("RD")) == 4, numbers("RD")), "geometry", "caret", "free text"),
        "field_kind": only(F.coalesce("kind", get("FT.n", "string")), "widget"),
        "field_name": only(F.coalesce(F.col("full_name"), text("T")), "widget"),
        "field_value": only(value, "widget"),
        "ends": only(F.when(F.size(numbers("L")) == 4, numbers("L")), "line"),
        "endings": only(F.transform(_variants("value", "$.LE"), lambda e: F.coalesce(F.try_variant_get(e, "$.n", "string"), F.lit("None"))), "line", "polygon"),
        "caption": only(F.coalesce(get("Cap", "boolean"), F.lit(False)), "line"),
        "vertices": only(numbers("Vertices"), "polygon"),
        "strokes": only(get("InkList", "array<array<double>>"), "ink"),
        "symbol": only(F.coalesce(get("Sy.n", "string"), F.lit("None")), "caret"),
        "parent": only(ref(F.col("value"), "$.Parent"), "popup"),
        "overlay": only(text("OverlayText"), "redaction"),
        "file": F.col("file"),
    }
    return found.select("doc_id", "page_index", "seq", "obj_num", "subtype", "family", "rect", "contents", "name", "modified", *[c.alias(n) for n, c in columns.items()])


def _fields_named(items: Column) -> Column:
    """What a list of fields or annotations names: their names, or object numbers."""
    each = F.transform(items, lambda f: F.struct(text_string(F.unhex(F.try_variant_get(f, "$.s", "string"))).alias("name"), ref(f, "$").alias("obj_num")))
    return F.filter(each, lambda f: f["name"].isNotNull() | f["obj_num"].isNotNull())


def typed_actions(objects: DataFrame) -> DataFrame:
    """Actions of all sources and their chains, a row each, with columns for what its kind holds, null for others.

    (doc_id, source_rank, source, place, depth, kind): those of actions(). dest_name, dest_page, dest_kind: where GoTo, GoToR and GoToE lead; names are looked up for
    GoTo, and pages of other files are numbers. file, new_window (GoToR, GoToE, Launch, Thread, ImportData), url (URI, SubmitForm), is_map (URI), fields, format, excluded (SubmitForm,
    ResetForm; excluded: all fields but these), shown (Hide: whether its targets, in fields, are shown), named (Named), script (JavaScript, from a text or a stream), layers, keep_radio (SetOCGState: a state
    ON, OFF or Toggle for each group in order), operation (Rendition, Movie, Sound). Other kinds have no columns of their own.
    """
    rows = action_rows(objects).withColumn("kind", F.try_variant_get("action", "$.S.n", "string"))
    rows = materialize(rows.withColumn("row", F.struct("source_rank", "source", "place", "depth", "id")))
    get = lambda k, kind: F.try_variant_get("action", f"$.{k}", kind)
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    only = lambda column, *kinds: F.when(is_(*kinds), column)
    key = ["doc_id", "row"]

    leaves = materialize(pages(objects, "navigation").select("doc_id", "page_obj", "page_index"))
    going = follow(rows.where(is_("GoTo", "GoToR", "GoToE")).select(*key, "kind", get("D", "variant").alias("dest")).where("dest is not null"), objects, "dest")
    going = going.withColumn("_raw", F.coalesce(F.upper(F.try_variant_get("dest", "$.s", "string")), F.hex(F.encode(F.try_variant_get("dest", "$.n", "string"), "UTF-8"))))
    names = named_destinations(objects, leaves).select("doc_id", F.col("raw_name").alias("_raw"), F.col("dest_page").alias("named_page"), F.col("dest_kind").alias("named_kind"), F.lit("GoTo").alias("kind"))
    placed = destination("dest", leaves, going).join(names, ["doc_id", "_raw", "kind"], "left")
    outside = F.when(F.col("kind") != "GoTo", F.try_variant_get("dest", "$[0]", "int"))
    placed = placed.select(*key, text_string(F.unhex("_raw")).alias("dest_name"), F.coalesce("dest_page", "named_page", outside).cast("int").alias("dest_page"), F.coalesce("dest_kind", "named_kind", F.when(outside.isNotNull(), F.try_variant_get("dest", "$[1].n", "string"))).alias("dest_kind"))

    specs = follow(rows.where(get("F", "variant").isNotNull() & is_("GoToR", "GoToE", "Launch", "Thread", "ImportData", "SubmitForm")).select(*key, get("F", "variant").alias("spec")), objects, "spec")
    specs = specs.select(*key, file_name("spec", "$").alias("file"))
    streams = objects.where("data is not null").select("doc_id", F.col("obj_num").alias("js_num"), "data")
    scripts = follow(rows.where(is_("JavaScript", "Rendition") & get("JS", "variant").isNotNull()).select(*key, get("JS", "variant").alias("js")), objects, "js")
    scripts = scripts.join(streams, ["doc_id", "js_num"], "left").select(*key, F.coalesce(text_string(F.unhex(F.try_variant_get("js", "$.s", "string"))), text_string(F.col("data"))).alias("script"))

    found = rows.join(placed, key, "left").join(specs, key, "left").join(scripts, key, "left")
    listed = _variants("action", "$.Fields")
    hidden = F.when(F.size(_variants("action", "$.T")) > 0, _variants("action", "$.T")).otherwise(F.array(get("T", "variant")))
    flags = F.coalesce(get("Flags", "long"), F.lit(0))
    set_ = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    format_ = F.coalesce(*[F.when(set_(bit), F.lit(name)) for bit, name in FORMATS.items()], F.lit("FDF"))
    states = _variants("action", "$.State")
    # A group's state is the last one named before it.
    named = F.transform(states, lambda s, i: F.struct(F.try_element_at(F.filter(F.transform(F.slice(states, F.lit(1), i + 1), lambda t: F.try_variant_get(t, "$.n", "string")), lambda n: n.isNotNull()), F.lit(-1)).alias("state"), ref(s, "$").alias("obj_num")))
    columns = {
        "new_window": only(get("NewWindow", "boolean"), "GoToR", "GoToE", "Launch"),
        "url": F.when(is_("URI"), variant_text(F.col("action"), "$.URI")).when(is_("SubmitForm"), F.col("file")),
        "is_map": only(F.coalesce(get("IsMap", "boolean"), F.lit(False)), "URI"),
        "fields": F.when(is_("SubmitForm", "ResetForm"), _fields_named(listed)).when(is_("Hide"), _fields_named(hidden)),
        "format": only(format_, "SubmitForm"),
        "excluded": only(set_(1), "SubmitForm", "ResetForm"),
        "shown": only(~F.coalesce(get("H", "boolean"), F.lit(True)), "Hide"),
        "named": only(get("N.n", "string"), "Named"),
        "script": F.col("script"),
        "layers": only(F.filter(named, lambda s: s["obj_num"].isNotNull() & s["state"].isNotNull()), "SetOCGState"),
        "keep_radio": only(F.coalesce(get("PreserveRB", "boolean"), F.lit(True)), "SetOCGState"),
        "operation": F.when(is_("Rendition"), get("OP", "string")).when(is_("Movie"), F.coalesce(get("Operation.n", "string"), F.lit("Play"))),
    }
    return found.select("doc_id", "source_rank", "source", "place", "depth", "kind", "dest_name", "dest_page", "dest_kind", F.when(~is_("SubmitForm"), F.col("file")).alias("file"), *[c.alias(n) for n, c in columns.items()])
