"""What resources give names for: graphics states, colour spaces, patterns and shadings."""

from quirel.operators import scene as S
from quirel.sources import objects as O
from quirel.sources import writer as W


def stream(data, entries=""):
    return f"<< /Length {len(data)} {entries} >>\nstream\n{data}\nendstream"


def scene(spark, content, resources, more=None, spliced=False):
    bodies = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << {resources} >> >>", 4: stream(content), **(more or {})}
    objects = O.read_objects(W.assemble(spark.createDataFrame([(1, n, b) for n, b in bodies.items()], "doc_id long, obj_num int, body string"))).checkpoint()
    return (S.spliced_nodes if spliced else S.scene_nodes)(objects).orderBy("node_id").collect()


def test_states_by_name(spark):
    states = "/ExtGState << /A << /LW 5 /LC 1 /ca 0.5 >> /B 10 0 R /C << /LW 9 /D [[3 1] 2] /SMask /None >> >>"
    b = {10: "<< /LJ 2 /CA 0.25 /BM [/Multiply /Screen] /ML 4 /SMask << /S /Luminosity /G 11 0 R >> >>"}
    line = " 0 0 m 1 1 l S "
    found = scene(spark, f"2 w /A gs{line}3 w{line}q /B gs /C gs{line}Q{line}/A gs /Gone gs{line}/A gs 7 w /A gs{line}/B gs{line}", states, b)
    assert [(r.line_width, r.line_cap, r.line_join) for r in found] == [(5.0, 1, 0), (3.0, 1, 0), (9.0, 1, 2), (3.0, 1, 0), (5.0, 1, 0), (5.0, 1, 0), (5.0, 1, 2)]
    assert [(r.fill_alpha, r.stroke_alpha, r.blend) for r in found[1:4]] == [(0.5, 1.0, "Normal"), (0.5, 0.25, "Multiply"), (0.5, 1.0, "Normal")]
    assert (found[2].dash, found[2].dash_phase, found[2].miter, found[2].mask) == ([3.0, 1.0], 2.0, 4.0, None)
    assert (found[-1].mask.kind, found[-1].mask.group, found[0].mask) == ("Luminosity", 11, None)


def test_forms_take_states_and_look_up_their_own(spark):
    form = "/Type /XObject /Subtype /Form /BBox [0 0 9 9]"
    more = {5: stream("0 0 m 1 1 l S /A gs 0 0 m 1 1 l S", form), 6: stream("/A gs 0 0 m 1 1 l S", form + " /Resources << /ExtGState << /A << /LW 8 >> >> >>")}
    found = scene(spark, "/B gs /X Do /Y Do 0 0 m 1 1 l S", "/XObject << /X 5 0 R /Y 6 0 R >> /ExtGState << /A << /LW 5 /CA 0.5 >> /B << /LW 2 /ca 0.75 >> >>", more, spliced=True)
    assert [(r.line_width, r.stroke_alpha, r.fill_alpha, r.level) for r in found] == [(2.0, 1.0, 0.75, 1), (5.0, 0.5, 0.75, 1), (8.0, 1.0, 0.75, 1), (2.0, 1.0, 0.75, 0)]


def test_colour_spaces(spark):
    tint = "<< /FunctionType 2 /Domain [0 1] /N 1 /C0 [1 1 1] /C1 [1 0 0] >>"
    spaces = {
        "Icc": ("[/ICCBased 10 0 R]", "1 0 0", "#ff0000"),
        "Alt": ("[/ICCBased 11 0 R]", "1 0 1 0", "#00ff00"),
        "Idx": ("[/Indexed /DeviceRGB 1 <0000FF00FF00>]", "1", "#00ff00"),
        "Over": ("[/Indexed [/ICCBased 10 0 R] 1 12 0 R]", "9", "#646566"),
        "Spot": (f"[/Separation /Red /DeviceRGB {tint}]", "0.5", "#ff8080"),
        "Ref": ("13 0 R", "1", "#ff0000"),
        "One": (f"[/DeviceN [/Red] [/ICCBased 10 0 R] {tint}]", "0", "#ffffff"),
        "Smp": ("[/Separation /S /DeviceGray 14 0 R]", "0.25", "#808080"),
        "Cal": ("[/CalGray << /WhitePoint [0.9505 1 1.089] >>]", "1", "#ffffff"),
        "Lab": ("[/Lab << /WhitePoint [0.9505 1 1.089] >>]", "0 0 0", "#000000"),
        "Two": ("[/DeviceN [/A /B] /DeviceRGB 14 0 R]", "0.5 0.5", None),
        "Dev": ("/DeviceCMYK", "0 0 0 0.5", "#808080"),
        "Odd": ("[/Unheard 1]", "0.5", None),
        "Few": ("[/ICCBased 10 0 R]", "1 0", None),
    }
    more = {10: stream("x", "/N 3"), 11: stream("x", "/Alternate /DeviceCMYK"), 12: stream("abcdef"), 13: f"[/Separation /Red /DeviceRGB 15 0 R]", 14: stream("\x00\x7f\x7f", "/FunctionType 0 /Size [2] /BitsPerSample 8 /Domain [0 1] /Range [0 1]"), 15: tint}
    more[14] = stream("@\x40", "/FunctionType 0 /Size [2] /BitsPerSample 8 /Domain [0 1] /Range [0 2]")
    content = " ".join(f"/{k} cs {v} scn 0 0 1 1 re f" for k, (_, v, _) in spaces.items())
    found = scene(spark, content, "/ColorSpace << " + " ".join(f"/{k} {d}" for k, (d, _, _) in spaces.items()) + " >>", more)
    assert {k: r.fill for k, r in zip(spaces, found)} == {k: c for k, (_, _, c) in spaces.items()}
    first = scene(spark, "/Spot cs 0 0 1 1 re f /Icc cs 0 0 1 1 re f /Spot CS 0.5 SCN 0 0 m 1 1 l S /DeviceRGB CS 0 0 m 1 1 l S /Nowhere cs 1 0 0 scn 0 0 1 1 re B", f"/ColorSpace << /Spot [/Separation /R /DeviceRGB {tint}] /Icc [/ICCBased 10 0 R] >>", more)
    assert [(r.fill, r.stroke) for r in first] == [("#ff0000", None), ("#000000", None), (None, "#ff8080"), (None, "#000000"), ("#ff0000", "#000000")]


def test_patterns_and_shadings(spark):
    resources = "/Pattern << /P 20 0 R >> /Shading << /P 21 0 R >> /ColorSpace << /Under [/Pattern /DeviceRGB] >>"
    found = scene(spark, "/Pattern cs /P scn 0 0 1 1 re f /Under CS 0 0 1 /P SCN 0 0 m 1 1 l S 1 0 0 rg 0 0 1 1 re f /P sh", resources)
    assert [(r.fill, r.fill_pattern, r.stroke, r.stroke_pattern) for r in found] == [(None, 20, None, None), (None, None, "#0000ff", 20), ("#ff0000", None, None, None), (None, 21, None, None)]
    assert found[-1].path == []
