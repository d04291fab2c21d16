import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirel.llm import cotraining, queries


def made(spark, n=800, known=200):
    """Good pages have words of one list and long lines, bad ones of another, marks and short lines; few are labelled."""
    rng = np.random.default_rng(6)
    good, bad = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(200)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.7)
        words = [str(rng.choice(good if rng.random() < (0.75 if y else 0.25) else bad)) for _ in range(30)]
        text = " ".join(words) if y else "##\n".join(" ".join(words[k : k + 3]) for k in range(0, 30, 3))
        rows.append((i, text, "en", f"src{i % 5}", y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, y int")
    return docs.drop("y"), docs.where(f"doc_id < {known}").select("doc_id", F.col("y").alias("quality")), {r[0]: r[4] for r in rows}


def test_held_out_accuracy(spark):
    docs, labels, truth = made(spark)
    rows = cotraining.score_quality(docs, labels).collect()
    assert len(rows) == 800
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    unseen = [r for r in rows if r.held_out or r.doc_id >= 200]
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97


def test_views_exchange_labels_and_each_learns_from_the_other():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        y = int(rng.random() < 0.5)
        shape = [0.0] * (len(cotraining.SHAPES) + 32)
        shape[0] = (2 * y - 1) + rng.normal() * 0.4
        rows.append((y, 1.0, [y * 10 + int(rng.integers(0, 8))], [1.0], shape))
    model = cotraining.CoTrained(rows[:100], [r[2:] for r in rows[100:]])
    assert min(model.exchanged) > 20
    for view in (1, 2):
        right = sum((model.score(*r[2:])[view] >= 0.5) == r[0] for r in rows[100:])
        assert right / 600 > 0.93


def test_shape_and_buckets():
    assert len(cotraining.page_shape("", None, None)) == len(cotraining.SHAPES) + 32
    assert cotraining.word_buckets("") == ([], [])
    places, values = cotraining.word_buckets("a b a C")
    assert len(places) == 3 and abs(sum(v * v for v in values) - 1) < 1e-9


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = made(spark, 300)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda lab: {r.doc_id: r.score for r in cotraining.score_quality(docs, lab).collect()}
    assert score(labels) == score(flipped)


def test_nulls_repeats_clashes_and_missing_labels(spark):
    docs, labels, _ = made(spark, 120, 80)
    odd = spark.createDataFrame([(9001, None, None, None), (None, "", "en", None), (3, "x " * 80_000, "fr", "s")], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd).withColumns({"score": F.lit("x"), "shape": F.lit(1), "body": F.lit(2)})
    assert cotraining.score_quality(docs, labels).count() == 123
    none = cotraining.score_quality(docs, labels.where("quality = 1")).collect()
    assert len(none) == 123 and {r.score for r in none} == {0.5}
    assert cotraining.score_quality(docs.where("false"), labels).collect() == []


def test_query_equals_plain_scoring(spark, sf_dir):
    """Every row's scores from the fitted weights alone, by plain loops."""
    docs, labels = (queries.table(spark, sf_dir, n) for n in ("documents", "labels"))
    model = cotraining.fit(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"), "lang", "source"), labels.select("doc_id", "quality"), "quality")
    texts = {r.doc_id: r for r in docs.collect()}
    rows = queries.op6_quality(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    sure = lambda x: 1 / (1 + math.exp(-x))
    for r in rows:
        d = texts[r.doc_id]
        counts = Counter()
        for w in (d.text or "").lower().split():
            counts[zlib.crc32(w.encode()) % cotraining.BUCKETS] += 1
        damped = {b: 1 + math.log(sum(1 for _ in range(n))) for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in damped.values())) or 1.0
        raw = sum(model.views[0].w[b] * v / norm for b, v in damped.items()) + model.views[0].bias
        shape = cotraining.page_shape(d.text or "", d.lang, d.source)
        page = sum(max(-5, min(5, (x - m) / s)) * w for x, m, s, w in zip(shape, model.mean, model.scale, model.views[1].w)) + model.views[1].bias
        odds = [a * x + b for (a, b), x in zip(model.slopes, (raw, page))]
        want = sure(model.final[0] * sum(odds) + model.final[1]), sure(odds[0]), sure(odds[1])
        assert all(abs(x - y) < 1e-6 for x, y in zip((r.score, r.text_score, r.page_score), want)) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
