import json
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirel.llm import queries, toxicity


def test_block_max_equals_brute_force():
    rng = np.random.default_rng(2)
    terms, n = 40, 700
    dense = (rng.random((n, terms)) < 0.08) * rng.random((n, terms))
    dense[:50] = dense[50:100]
    dense /= np.maximum(np.sqrt((dense**2).sum(1)), 1e-9)[:, None]
    vectors = [{int(t): float(row[t]) for t in np.flatnonzero(row)} for row in dense]
    index = toxicity.BlockMaxIndex(vectors, np.zeros(n, int), np.ones(n), terms)
    for _ in range(200):
        t = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)).astype(np.float32)
        got, cosines = index.nearest(t, w, k=9)
        want = np.array([sum(w[i] * np.float32(vectors[j].get(int(x), 0)) for i, x in enumerate(t)) for j in index.order])
        top = np.sort(want[want > 0])[::-1][:9]
        assert len(got) == len(top) and np.allclose(cosines, top, atol=1e-5)
        assert np.allclose(want[got], cosines, atol=1e-5)


def test_isotonic_rises():
    x, y = np.array([0.1, 0.2, 0.2, 0.5, 0.7, 0.9]), np.array([0, 1, 0, 0, 1, 1])
    edges, values = toxicity.isotonic(x, y, np.ones(6))
    assert (np.diff(values) >= 0).all() and (np.diff(edges) >= 0).all() and 0 <= values[0] <= values[-1] <= 1


def made(spark, n=600):
    """Texts of random words; a third of them holds two of five bad words and is labelled 1."""
    rng = np.random.default_rng(8)
    common, bad = [f"word{i}" for i in range(300)], ["awful", "nasty", "vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(common, 40))
        if i % 3 == 0:
            for b in rng.choice(bad, 2, replace=False):
                w.insert(int(rng.integers(0, 40)), b.upper() + "!" if i % 2 else b)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = made(spark)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 600
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in unseen) / len(unseen) > 0.95
    assert all(r.evidence and r.evidence[0].label == 1 for r in rows if r.predicted)


def test_held_out_labels_are_not_read(spark):
    docs, labels = made(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda lab: {r.doc_id: r.score for r in toxicity.score_documents(docs, lab).collect()}
    assert score(labels) == score(flipped)


def test_nulls_repeats_clashes_and_missing_labels(spark):
    docs, labels = made(spark, 150)
    odd = spark.createDataFrame([(9001, None), (9001, ""), (None, "awful nasty " * 30_000), (5, "awful vile")], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumns({"score": F.lit("x"), "y": F.lit(1), "terms": F.lit(2)})
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (7, None), (77777, 1), (8, 0), (8, 1)], "doc_id long, toxic int"))
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 154
    empty = {r.score for r in rows if r.doc_id == 9001}
    assert len(empty) == 1
    none = toxicity.score_documents(docs, labels.where("false")).collect()
    assert len(none) == 154 and {r.predicted for r in none} == {0}
    assert toxicity.score_documents(docs.where("false"), labels).collect() == []


def test_query_equals_exhaustive_votes(spark, sf_dir):
    """Scores, labels and evidence of the query against all examples, compared one by one with the fitted model's terms."""
    docs, labels = (queries.table(spark, sf_dir, n) for n in ("documents", "labels"))
    model, _ = toxicity.fit_votes(docs, labels, "toxic", "doc_id", "text")
    index, texts = model.index, {r.doc_id: r.text or "" for r in docs.collect()}
    inverse = {p: t for t, p in model.places.items()}
    rows = queries.op4_toxicity(spark, sf_dir).collect()
    assert len(rows) == docs.count()
    for r in rows:
        counts = Counter()
        for w in texts[r.doc_id].lower().split():
            w = w.strip(toxicity._EDGES)
            counts.update([w, *(w[:n] + "~" for n in (4, 5) if len(w) > n)])
        held = {p: (1 + math.log(counts[t])) * model.idf[p] for p, t in inverse.items() if counts[t]}
        norm = math.sqrt(sum(w * w for w in held.values())) or 1.0
        cosines = sorted(((sum(w / norm * float(index.dense[p, at]) for p, w in held.items()), -at) for at in range(len(index.order))), reverse=True)
        near = [(c, -at) for c, at in cosines[: toxicity.NEIGHBOURS] if c > 1e-7]
        share = [c**2 * index.weights[at] / index.weights.max() for c, at in near]
        raw = (sum(s * index.ys[at] for s, (_, at) in zip(share, near)) + toxicity.PRIOR * model.base) / (sum(share) + toxicity.PRIOR) if near else -1.0
        assert abs(r.score - model.calibrated(raw)) < 1e-3 and r.predicted == (r.score >= 0.5), r.doc_id
        assert len(json.loads(r.evidence)) == min(3, len(near))
