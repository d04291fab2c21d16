"""Visibility expressions: operators without operands, unknown layers, nesting, void expressions."""

from pyspark.sql import functions as F

from quirel.operators import catalogue as C

EXPRESSIONS = {
    1: '[{"n": "And"}]',
    2: '[{"n": "Or"}]',
    3: '[{"n": "Not"}]',
    4: '[{"n": "Not"}, {"r": [11, 0]}, {"r": [10, 0]}]',
    5: '[{"n": "And"}, {"r": [10, 0]}, [{"n": "Not"}, {"r": [99, 0]}]]',
    6: '[{"n": "Or"}, {"r": [99, 0]}, [{"n": "And"}, [{"n": "Or"}, {"r": [10, 0]}], {"r": [11, 0]}]]',
    7: '[{"n": "Xor"}, {"r": [10, 0]}]',
    8: '[{"n": "And"}, {"r": [10, 0]}, [{"n": "Not"}]]',
}


def test_expressions(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in EXPRESSIONS.items()], "doc_id long, member_id long, t string")
    states = spark.createDataFrame([(1, 10, True), (1, 11, False)], "doc_id long, obj_num long, visible boolean")
    found = C.expression_visible(rows.select("doc_id", "member_id", F.parse_json("t").alias("node")), states)
    assert {r.member_id: r.visible for r in found.collect()} == {1: True, 2: False, 4: True, 5: True, 6: False, 8: True}


def test_no_expressions(spark):
    rows = spark.createDataFrame([], "doc_id long, member_id long, t string").select("doc_id", "member_id", F.parse_json("t").alias("node"))
    states = spark.createDataFrame([], "doc_id long, obj_num long, visible boolean")
    assert C.expression_visible(rows, states).count() == 0
