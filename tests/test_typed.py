"""Columns by kind of annotations and actions, and what form fields have from those above them."""

from quirel.operators import catalogue as C
from quirel.operators import typed as D
from quirel.sources import objects as O
from quirel.sources import writer as W


def objects_of(spark, bodies):
    return O.read_objects(W.assemble(spark.createDataFrame([(1, n, b) for n, b in bodies.items()], "doc_id long, obj_num int, body string"))).checkpoint()


def stream(data, entries=""):
    return f"<< /Length {len(data)} {entries} >>\nstream\n{data}\nendstream"


def page_with(notes, catalog=""):
    """A document of one page with these annotations, numbered from 10 on."""
    numbers = " ".join(f"{10 + i} 0 R" for i in range(len(notes)))
    return {1: f"<< /Type /Catalog /Pages 2 0 R {catalog} >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: f"<< /Type /Page /Parent 2 0 R /Annots [{numbers}] >>", **{10 + i: f"<< /Rect [0 0 9 9] {n} >>" for i, n in enumerate(notes)}}


def test_annotations_by_family(spark):
    notes = [
        "/Subtype /Text /T (Ann) /Open true /State (Accepted) /StateModel (Review) /IRT 11 0 R /F 6 /C [1 0 0] /CA 0.5 /CreationDate (D:2024)",
        "/Subtype /FreeText /DA (0 g) /Q 2 /IT /FreeTextCallout /RD [1 2 3 4] /BS << /W 3 >>",
        "/Subtype /Squiggly /QuadPoints [0 0 1 0 0 1 1 1] /Popup 15 0 R /Border [0 0 2]",
        "/Subtype /Circle /IC [0 1 0] /RD [1 2]",
        "/Subtype /Line /L [1 2 3 4] /LE [/Square 7] /Cap true",
        "/Subtype /Popup /Parent 12 0 R",
        "/Subtype /Ink /InkList [[0 0 1 1] [2 2 3 3]]",
        "/Subtype /FileAttachment /FS 30 0 R /Name /Tag",
        "/Subtype /Stamp",
        "/Subtype /PolyLine /Vertices [0 0 4 4]",
        "/Subtype /Caret /Sy /P",
        "/Subtype /Redact /OverlayText (gone) /QuadPoints [0 0 0 0 0 0 0 0]",
        "/Subtype /Sonnet /QuadPoints 7 /T 7",
        "/Rect 3",
    ]
    found = D.typed_annotations(objects_of(spark, page_with(notes) | {30: "<< /F (old.txt) /UF (new.txt) >>"})).orderBy("seq").collect()
    assert [r.family for r in found] == ["note", "free text", "markup", "geometry", "line", "popup", "ink", "file", "stamp", "polygon", "caret", "redaction", "other", "other"]
    note, free, markup, circle, line, popup, ink, file, stamp, poly, caret, redact, other, _ = found
    assert (note.icon, note.open, note.author, note.state, note.state_model, note.reply_to, note.colour, note.opacity, note.created) == ("Note", True, "Ann", "Accepted", "Review", 11, [1.0, 0.0, 0.0], 0.5, "2024")
    assert note.flags == ["hidden", "print"] and free.flags == [] and free.opacity == 1.0
    assert (free.appearance, free.quadding, free.intent, free.insets, free.border) == ("0 g", 2, "FreeTextCallout", [1.0, 2.0, 3.0, 4.0], 3.0)
    assert (markup.quads, markup.popup, markup.border, markup.icon) == ([0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0], 15, 2.0, None)
    assert (circle.interior, circle.insets, circle.border) == ([0.0, 1.0, 0.0], None, 1.0)
    assert (line.ends, line.endings, line.caption) == ([1.0, 2.0, 3.0, 4.0], ["Square", "None"], True)
    assert (popup.parent, popup.open, ink.strokes) == (12, False, [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]])
    assert (file.file, file.icon, stamp.icon, poly.vertices, caret.symbol, redact.overlay) == ("new.txt", "Tag", "Draft", [0.0, 0.0, 4.0, 4.0], "P", "gone")
    assert other.quads is None and other.author is None


def test_widgets_take_kind_and_value_from_fields_above(spark):
    bodies = page_with(["/Subtype /Widget /Parent 20 0 R", "/Subtype /Widget /T (own) /FT /Btn /V /Yes /Parent 21 0 R", "/Subtype /Widget /FT /Tx /T (loose) /V (free)"], "/AcroForm << /Fields [21 0 R] >>")
    bodies |= {20: "<< /T (inner) /Parent 21 0 R /Kids [10 0 R] >>", 21: "<< /T (outer) /FT /Tx /Ff 3 /V (held) /Kids [20 0 R 11 0 R 21 0 R] >>"}
    objects = objects_of(spark, bodies)
    found = D.typed_annotations(objects).orderBy("seq").collect()
    assert [(r.field_kind, r.field_name, r.field_value) for r in found] == [("Tx", "outer.inner", "held"), ("Btn", "outer.own", "Yes"), ("Tx", "loose", "free")]
    fields = {tuple(r.path): (r.full_name, r.kind, r.flags) for r in C.form_fields(objects).collect()}
    assert fields == {(0,): ("outer", "Tx", 3), (0, 0): ("outer.inner", "Tx", 3), (0, 0, 0): ("outer.inner", "Tx", 3), (0, 1): ("outer.own", "Btn", 3)}


def test_signature_kind_from_two_fields_above(spark):
    bodies = {1: "<< /Type /Catalog /AcroForm << /Fields [2 0 R] >> >>", 2: "<< /FT /Sig /Kids [3 0 R] >>", 3: "<< /T (a) /Kids [4 0 R] >>", 4: "<< /T (b) /V 5 0 R >>", 5: "<< /SubFilter /adbe.pkcs7.detached /ByteRange [0 1 2 3] >>", 6: "<< /FT /Tx /V 5 0 R >>"}
    assert [r.field_num for r in C.signatures(objects_of(spark, bodies)).collect()] == [4]


def test_actions_by_kind(spark):
    acts = [
        "/S /GoTo /D [3 0 R /Fit]",
        "/S /GoTo /D (here)",
        "/S /GoToR /F << /UF (other.pdf) >> /NewWindow true /D [4 /XYZ 0 0 0]",
        "/S /Launch /F (tool)",
        "/S /URI /URI (http://x) /IsMap true",
        "/S /Hide /T [(a) 12 0 R] /H false",
        "/S /SubmitForm /F << /FS /URL /F (http://y) >> /Flags 33 /Fields [(a) 20 0 R 7]",
        "/S /ResetForm",
        "/S /SetOCGState /State [40 0 R /ON 41 0 R 42 0 R /Toggle 41 0 R] /PreserveRB false",
        "/S /JavaScript /JS 30 0 R",
        "/S /Named /N /NextPage",
        "/S /Rendition /OP 2",
        "/S /Unheard",
    ]
    bodies = page_with([f"/Subtype /Screen /A << {a} >>" for a in acts], "/Names << /Dests << /Names [(here) [3 0 R /FitH 5]] >> >>") | {30: stream("run();")}
    found = D.typed_actions(objects_of(spark, bodies)).collect()
    assert len(found) == len(acts)
    by = {int(r.place.split(".")[1]): r for r in found}
    assert [(by[i].dest_name, by[i].dest_page, by[i].dest_kind) for i in (0, 1, 2, 3)] == [(None, 0, "Fit"), ("here", 0, "FitH"), (None, 4, "XYZ"), (None, None, None)]
    assert (by[2].file, by[2].new_window, by[3].file, by[3].new_window) == ("other.pdf", True, "tool", None)
    assert (by[4].url, by[4].is_map, by[0].is_map) == ("http://x", True, None)
    assert by[5].shown is True and [(f.name, f.obj_num) for f in by[5].fields] == [("a", None), (None, 12)]
    assert (by[6].url, by[6].format, by[6].excluded, by[6].file) == ("http://y", "XFDF", True, None) and [(f.name, f.obj_num) for f in by[6].fields] == [("a", None), (None, 20)]
    assert by[7].fields == [] and by[7].excluded is False and by[7].format is None
    assert [(s.state, s.obj_num) for s in by[8].layers] == [("ON", 41), ("ON", 42), ("Toggle", 41)] and by[8].keep_radio is False
    assert (by[9].script, by[10].named, by[11].operation, by[12].kind) == ("run();", "NextPage", "2", "Unheard")


def test_documents_without_any(spark):
    objects = objects_of(spark, page_with([]))
    assert D.typed_annotations(objects).count() == 0 and D.typed_actions(objects).count() == 0
