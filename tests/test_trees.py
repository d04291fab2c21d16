"""Trees and lists that the writers make, against what the readers find in them."""

import random

from pyspark.sql import functions as F

from quirel.operators import catalogue as C
from quirel.sources import objects as O
from quirel.sources import trees as B
from quirel.sources import writer as W

HEAD = "<< /Type /Catalog /Names << /Dests {} >> >>"


def objects_of(spark, bodies):
    return O.read_objects(W.assemble(bodies)).checkpoint()


def with_catalog(tree):
    heads = B.root_refs(tree).select("doc_id", F.lit(1).cast("long").alias("obj_num"), F.concat(F.lit("<< /Type /Catalog /Names << /Dests "), F.col("root"), F.lit(" >> >>")).alias("body"))
    return tree.select("doc_id", "obj_num", "body").unionByName(heads)


def test_hundred_thousand_keys_make_three_levels(spark):
    entries = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.encode(F.format_string("k%06d", "id"), "UTF-8").alias("key"), F.col("id").cast("string").alias("value"))
    tree = B.name_tree(entries, 10)
    assert tree.agg(F.max("depth")).first()[0] == 2 and tree.where("is_root").count() == 1
    assert tree.count() == 1563 + 25 + 1 and tree.select("obj_num").distinct().count() == 1589


def test_lookup_equals_scan_and_filter(spark):
    rng = random.Random(4)
    entries = [(d, bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 5))), str(i)) for d, n in ((1, 300), (2, 8), (3, 1)) for i in range(n)]
    tree = B.name_tree(spark.createDataFrame(entries, "doc_id long, key binary, value string"), 10, fan=4)
    objects = objects_of(spark, with_catalog(tree))
    start = C.from_catalog(objects, "Names.Dests")
    want = {}
    for d, k, v in entries:
        want[d, k] = min(want.get((d, k), v), v)
    scanned = C.tree_entries(objects, start, "Names").select("doc_id", F.unhex(F.try_variant_get("key", "$.s", "string")).alias("key"), F.try_variant_get("entry", "$", "string").alias("value"))
    assert {(r.doc_id, bytes(r.key)): r.value for r in scanned.collect()} == want
    assert [bytes(r.key) for r in scanned.collect() if r.doc_id == 2] and scanned.count() == len(want)
    probes = [(d, k) for d, k in want] + [(d, k + b"a") for d, k in want] + [(1, b"zz"), (9, b"a"), (2, b""), (2, b"")]
    found = C.tree_lookup(objects, start, spark.createDataFrame(probes, "doc_id long, key binary")).select("doc_id", "key", F.try_variant_get("entry", "$", "string").alias("value"), "visited").collect()
    assert {(r.doc_id, bytes(r.key)): r.value for r in found} == {p: want.get(p) for p in probes} and len(found) == len(set(probes))
    levels = tree.where("doc_id = 1").agg(F.max("depth")).first()[0] + 1
    assert levels >= 4 and max(r.visited for r in found if r.doc_id == 1) == levels < tree.where("doc_id = 1").count() / 5
    assert {r.visited for r in found if r.doc_id == 9} == {0}


def test_lookup_in_odd_trees(spark):
    bodies = {
        1: HEAD.format("2 0 R"),
        2: "<< /Kids [3 0 R 4 0 R 5 0 R 2 0 R] >>",
        3: "<< /Limits [(a) (c)] /Names [(a) 1 (c) 3 (odd)] >>",
        4: "<< /Names [(b) 2 (c) 33] >>",
        5: "<< /Limits [(x) (z)] /Kids [<< /Limits [(y) (y)] /Names [(y) (inline)] >> 9 0 R 2 0 R] >>",
    }
    objects = objects_of(spark, spark.createDataFrame([(1, n, b) for n, b in bodies.items()], "doc_id long, obj_num int, body string"))
    probes = spark.createDataFrame([(1, k.encode()) for k in ("a", "b", "c", "y", "odd", "z")], "doc_id long, key binary")
    found = {bytes(r.key): r.e for r in C.tree_lookup(objects, C.from_catalog(objects, "Names.Dests"), probes).select("key", F.to_json("entry").alias("e")).collect()}
    assert found == {b"a": "1", b"b": "2", b"c": "3", b"y": '{"s":"696e6c696e65"}', b"odd": None, b"z": None}


def test_number_trees_and_no_entries(spark):
    entries = spark.createDataFrame([(1, k, str(k)) for k in (-5, 3, 0, 3, 100)] + [(1, None, "0"), (2, 7, "x")], "doc_id long, key long, value string")
    rows = {(r.doc_id, r.obj_num): r.body for r in B.number_tree(entries, 5, fan=2).collect()}
    assert rows[1, 5] == "<< /Limits [-5 0] /Nums [-5 -5 0 0] >>" and rows[1, 7] == "<< /Kids [5 0 R 6 0 R] >>" and rows[2, 5] == "<< /Nums [7 x] >>"
    assert B.name_tree(spark.createDataFrame([], "doc_id long, key binary, value string"), 5).count() == 0


def test_outlines(spark):
    items = [(1, 1, None, 0, "a", None, True), (1, 2, 1, 5, "b", "[9 0 R /Fit]", False), (1, 3, 1, 5, "c", None, None), (1, 4, 2, 0, "d", None, True), (1, 5, 2, 1, None, None, True), (1, 6, None, 1, "e", None, True)]
    items += [(1, 7, 8, 0, "round", None, True), (1, 8, 7, 0, "round", None, True), (1, 9, 99, 0, "lost", None, True), (2, 1, None, 0, "only", None, False)]
    rows = {(r.doc_id, r.obj_num): r.body for r in B.outline_objects(spark.createDataFrame(items, "doc_id long, item int, parent int, place int, title string, dest string, is_open boolean"), 10).collect()}
    assert set(rows) == {(1, n) for n in (10, 11, 12, 13, 14, 15, 16)} | {(2, 10), (2, 11)}
    assert rows[1, 10] == "<< /Type /Outlines /First 11 0 R /Last 16 0 R /Count 4 >>" and rows[2, 10].endswith("/First 11 0 R /Last 11 0 R /Count 1 >>")
    assert "/Next 16 0 R /First 12 0 R /Last 13 0 R /Count 2 >>" in rows[1, 11] and "/Prev" not in rows[1, 11]
    assert rows[1, 12].endswith("/Next 13 0 R /First 14 0 R /Last 15 0 R /Count -2 /Dest [9 0 R /Fit] >>") and "/Parent 11 0 R /Prev 12 0 R >>" in rows[1, 13]
    objects = objects_of(spark, spark.createDataFrame([(*k, v) for k, v in rows.items()] + [(d, 1, "<< /Type /Catalog /Outlines 10 0 R >>") for d in (1, 2)], "doc_id long, obj_num long, body string"))
    assert [(r.title, r.depth) for r in C.outline(objects).orderBy("doc_id", "node_id").collect()] == [("a", 0), ("b", 1), ("d", 2), ("", 2), ("c", 1), ("e", 0), ("only", 0)]


def test_attachments(spark):
    rows = [(1, bytes([i % 256, i // 256]), f"f{i}", f"body ({i}", "text/plain" if i % 2 else None, None, f"about {i}" if i % 3 else None) for i in range(200)] + [(1, b"\0\0", "z", "loses", None, None, None)]
    files = spark.createDataFrame(rows, "doc_id long, key binary, name string, data string, mime string, modified timestamp, description string")
    objects, root = B.attachment_objects(files, 20)
    heads = root.select("doc_id", F.lit(1).cast("long").alias("obj_num"), F.concat(F.lit("<< /Type /Catalog /Names << /EmbeddedFiles "), F.col("root"), F.lit(" >> >>")).alias("body"))
    found = C.attachments(objects_of(spark, objects.unionByName(heads))).orderBy("seq").select("name", F.col("bytes").cast("string").alias("b"), "mime").collect()
    want = sorted(rows[:-1], key=lambda r: r[1])
    assert [(r.name, r.b, r.mime) for r in found] == [(w[2], w[3], w[4]) for w in want]
