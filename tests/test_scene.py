"""Scenes: line states, inherited states of forms, and references that lead through others."""

from pyspark.sql import functions as F

from quirel.operators import pages as P
from quirel.operators import scene as S
from quirel.sources import objects as O
from quirel.sources import writer as W


def stream(data, entries=""):
    return f"<< /Length {len(data)} {entries} >>\nstream\n{data}\nendstream"


def objects_of(spark, bodies):
    return O.read_objects(W.assemble(spark.createDataFrame([(1, n, b) for n, b in bodies.items()], "doc_id long, obj_num int, body string"))).checkpoint()


def test_line_states_pass_into_forms(spark):
    form = "/Type /XObject /Subtype /Form /BBox [0 0 9 9]"
    bodies = {
        1: "<< /Type /Catalog /Pages 2 0 R >>",
        2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /X 5 0 R >> >> >>",
        4: stream("0 0 m 1 1 l S q 3 w 1 J 2 j 4 M [2 1] 0.5 d /X Do Q 0 0 m 2 2 l S"),
        5: stream("0 0 m 3 3 l S 0 J [] 0 d 7 w 0 0 m 4 4 l S", form),
    }
    found = S.spliced_nodes(objects_of(spark, bodies)).orderBy("node_id").collect()
    assert [(r.line_width, r.line_cap, r.line_join, r.miter, r.dash, r.dash_phase) for r in found] == [(1.0, 0, 0, 10.0, [], 0.0), (3.0, 1, 2, 4.0, [2.0, 1.0], 0.5), (7.0, 0, 2, 4.0, [], 0.0), (1.0, 0, 0, 10.0, [], 0.0)]
    assert [r.level for r in found] == [0, 1, 1, 0] and {r.stroke for r in found} == {"#000000"}
    own = S.scene_nodes(objects_of(spark, bodies)).orderBy("node_id").collect()
    assert [r.node_id for r in own] == [0, 1] and [r.path[1].p for r in own] == [[1.0, 1.0], [2.0, 2.0]]


def test_references_lead_through_others(spark):
    bodies = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids 5 0 R /Count 1 >>", 3: "<< /Type /Page /Parent 2 0 R >>", 5: "6 0 R", 6: "7 0 R", 7: "[3 0 R]", 8: "9 0 R", 9: "8 0 R", 10: "99 0 R"}
    objects = objects_of(spark, bodies)
    assert P.pages(objects).count() == 1
    assert {r.obj_num: r.j for r in objects.where("obj_num in (5, 6, 10)").select("obj_num", F.to_json("value").alias("j")).collect()} == {5: '[{"r":[3,0]}]', 6: '[{"r":[3,0]}]', 10: "null"}
    assert objects.where("obj_num in (8, 9) and error is null").count() == 2
