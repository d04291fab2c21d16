import hashlib

from pyspark.sql import functions as F

from quirel.llm import exact_dedup, mixing


def rows_of(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, "a "), (None, "a"), (None, "z"), (None, "z"), (6, "long " * 50_000), (7, "long " * 50_000)], "doc_id long, text string").withColumns({"body": F.lit(1), "digest": F.lit(2), "id": F.lit(3), "n": F.lit(4)})


def test_nulls_ties_and_repeats(spark):
    for keep, want in (("largest", {1: 2, 2: 2, 3: 4, 4: 4, 5: 5, 6: 7, 7: 7}), ("smallest", {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6})):
        rows = exact_dedup.exact_duplicates(rows_of(spark), keep=keep).collect()
        assert len(rows) == 11
        assert {r.doc_id: r.keep_id for r in rows if r.doc_id} == want
        assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows}) == 5
        assert {r.group_size for r in rows if r.text_sha256 == hashlib.sha256(b"a").hexdigest()} == {4}
        left = exact_dedup.drop_exact_duplicates(rows_of(spark), keep=keep)
        assert left.columns == rows_of(spark).columns
        assert sorted((r.doc_id or 0) for r in left.collect()) == sorted({0, *want.values()})


def test_texts_of_equal_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    rows = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_index_merges_runs(spark):
    index = exact_dedup.DigestIndex(spark, keep="smallest")
    index.flush(spark.createDataFrame([(10, 5), (11, 6)], "digest long, id long"))
    index.flush(spark.createDataFrame([(10, 2), (12, 7)], "digest long, id long"))
    before = sorted(map(tuple, index.entries().collect()))
    index.compact()
    assert before == sorted(map(tuple, index.entries().collect())) == [(10, 2, 2), (11, 1, 6), (12, 1, 7)]
    assert len(index.runs) == 1 and [tuple(r) for r in index.lookup([10]).collect()] == [(10, 2, 2)] and [r.digest for r in index.repeated().collect()] == [10]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert exact_dedup.exact_duplicates(empty).collect() == [] and exact_dedup.drop_exact_duplicates(empty).collect() == []
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_targets_and_copies(spark):
    rng_rows = [(i, "w " * (1 + i % 50), f"s{i % 4}" if i % 9 else None) for i in range(4000)] + [(5, None, "void"), (5, "", "void"), (None, "x y", "s1"), (4001, "long " * 5000, "s2")]
    docs = spark.createDataFrame(rng_rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit(1)})
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(rng_rows) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    sources, taken = {}, {}
    by_id = {i: s for i, _, s in rng_rows if i != 5}
    for r in rows:
        assert r.taken <= 2 * r.size
        if r.doc_id in by_id:
            s = by_id[r.doc_id]
            sources[s] = r.target, r.source_size
            taken[s] = taken.get(s, 0) + r.taken
    for s, (target, size) in sources.items():
        assert target <= 2 * size and abs(taken[s] - target) < 0.002 * target + 60, s
    total = sum(size for _, size in sources.values())
    assert abs(sum(t for t, _ in sources.values()) - 1.5 * total) < 1
    assert {r.target for r in rows if r.source_size == 0} == {0.0}
