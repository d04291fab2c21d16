"""The range join against all pairs; bookmarks that aren't reached."""

import random

from pyspark.sql import functions as F

from quirel.operators import catalogue as C
from quirel.operators import validity as V
from quirel.sources import objects as O
from quirel.sources import writer as W


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(6)
    ranges = [(rng.choice("ab"), i, low := rng.randrange(-50, 400), low + rng.choice([-3, 0, 1, 9, 10, 11, 150])) for i in range(150)] + [("a", 900, None, 5), (None, 901, 0, 500)]
    moments = [(rng.choice("ab"), i, rng.randrange(-60, 450)) for i in range(400)] + [("a", 900, None), (None, 901, 3), ("a", 902, 10), ("a", 902, 10)]
    left, right = spark.createDataFrame(moments, "k string, m int, t long"), spark.createDataFrame(ranges, "k string, r int, low long, high long")
    want = sorted((k, m, r) for k, m, t in moments for q, r, low, high in ranges if k == q and k and None not in (t, low, high) and low <= t <= high)
    for width in (1, 10, 1000):
        found = V.in_force(left, right, ["k"], F.col("t"), F.col("low"), F.col("high"), width)
        assert found.columns == ["k", "m", "t", "r", "low", "high"] and sorted((x.k, x.m, x.r) for x in found.collect()) == want
    assert len(want) > 1000


def test_lost_bookmarks_are_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "LEVEL_ITEMS", 3)
    item = lambda n, last: f"<< /Title (t{n}) /Parent 2 0 R" + ("" if last else f" /Next {n + 1} 0 R") + " >>"
    bodies = {1: "<< /Type /Catalog /Outlines 2 0 R /Pages 3 0 R >>", 2: "<< /Type /Outlines /First 10 0 R >>", 3: "<< /Type /Pages /Kids [] >>", **{n: item(n, n == 14) for n in range(10, 15)}, 20: "<< /Title (stray) /Parent 2 0 R >>"}
    objects = O.read_objects(W.assemble(spark.createDataFrame([(1, n, b) for n, b in bodies.items()], "doc_id long, obj_num int, body string"))).checkpoint()
    assert [r.title for r in C.outline(objects).orderBy("node_id").collect()] == ["t10", "t11", "t12"]
    assert sorted((r.obj_num, r.severity) for r in C.outline_issues(objects).collect()) == [(13, "error"), (14, "error"), (20, "error")]
