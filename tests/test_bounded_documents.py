"""Queries whose documents must not grow with the table."""

import datetime

from quirel.plans import catalog
from quirel.sources import writer as W


def largest_document(monkeypatch):
    """A list that gets the most objects of a document of each assembly."""
    seen, plain = [], W.assemble

    def assemble(objects, *a, **b):
        seen.append(objects.groupBy("doc_id").count().agg({"count": "max"}).first()[0])
        return plain(objects, *a, **b)

    monkeypatch.setattr(W, "assemble", assemble)
    return seen


def test_outline_keeps_levels_beyond_the_limit(spark, tmp_path):
    spark.createDataFrame([(0, 3, "A"), (1, 3, "B"), (2, 3, "C")], "n_nationkey int, n_regionkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1, 10_101).selectExpr("id as c_custkey", "'c' || id as c_name", "int(if(id % 100 = 0, 2, 0)) as c_nationkey").unionByName(spark.range(10_101, 20_201).selectExpr("id as c_custkey", "'c' || id as c_name", "0 as c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = sorted(catalog.outline_tree(spark, str(tmp_path)).collect(), key=lambda r: r.node_id)
    first, last = [k for k in range(1, 20_201) if k > 10_100 or k % 100], [k for k in range(1, 10_101) if k % 100 == 0]
    titles = ["A", *[f"c{k}" for k in first], "B", "C", *[f"c{k}" for k in last]]
    assert [(r.doc_id, r.node_id, r.title) for r in rows] == [(3, i, t) for i, t in enumerate(titles)]
    assert [r.descendants for r in rows if r.depth == 0] == [len(first), 0, len(last)] and sum(r.descendants for r in rows if r.depth) == 0


def test_a_hot_users_files_are_many_documents(spark, tmp_path, monkeypatch):
    day = datetime.datetime(2024, 1, 1)
    events = [(i * 97, 7 if i % 10 else 8, "{}", day) for i in range(2500)]
    spark.createDataFrame(events, "event_id long, user_id long, props string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    seen = largest_document(monkeypatch)
    rows = sorted(catalog.attached_files(spark, str(tmp_path)).collect())
    want = [(u, k, f"event-{e}") for u in (7, 8) for k, e in enumerate(e for e, v, *_ in events if v == u)]
    assert [(r.doc_id, r.seq, r.name) for r in rows] == want
    # Two objects a file, and the nodes of their name tree.
    assert max(seen) <= 2 * catalog.FILES + catalog.FILES // 60 + 4 < 4500
