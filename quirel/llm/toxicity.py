"""Toxicity by the nearest labelled examples, found exactly by TF-IDF cosine in a block-max inverted index.

Terms are all words whose presence tells the labels apart significantly in a bounded sample of labelled rows; their
document frequencies are counted over all documents. The sample's vectors are the examples. Their index keeps, per
block of examples and term, the largest weight; a query takes blocks by their upper bounds
and stops when no block left can beat its k-th neighbour.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_texts, stored, text_or_empty

#: Examples of a label at most: with the words that they hold they bound the index.
EXAMPLES = 1500
#: What makes a word of the examples a term: rows that it must occur in, and the likelihood ratio statistic that it must
#: reach (one word in a million does by chance). Every such word is one, however many there are.
LEAST_ROWS, LEAST_G = 4, 24.0
NEIGHBOURS, BLOCK = 15, 64
#: Votes of the base rate.
PRIOR = 0.3

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


#: Lengths of the beginnings, marked by a tilde, that longer words have as terms besides themselves: inflected words share them.
STEMS = (4, 5)


def words(text: str) -> list[str]:
    return text.lower().split()


def _terms(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)] if word else []


def _presence() -> Callable[[list], dict]:
    """A text's different terms, and two smallest hashes of its word triples, which near copies mostly share."""

    def least(text: str, seed: int) -> int:
        w = words(text)
        return min((xxhash.xxh32_intdigest(" ".join(w[i : i + 3]), seed) for i in range(max(1, len(w) - 2))), default=0)

    return lambda texts: {"terms": [sorted({s for w in set(words(t)) for s in _terms(w.strip(_EDGES))}) for t in texts], "m1": [least(t, 1) for t in texts], "m2": [least(t, 2) for t in texts]}


def _once(sample: DataFrame) -> DataFrame:
    """The sample's rows without copies and most near copies, whose words would all seem to tell labels apart."""
    for m in ("m1", "m2"):
        sample = sample.join(sample.groupBy(m).agg(F.min("id").alias("first")), m).where("id = first").drop("first")
    return sample


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", most: int = EXAMPLES) -> DataFrame:
    """(id, y, rows): up to `most` ids of each label, those that hash lowest, and how many rows have the label.

    Only rows outside the held-out fifth count; an id with both labels has the larger. Ids without a document aren't taken.
    """
    known = columns(labels, id_col, label).toDF("id", "y").where("id is not null and y is not null").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    known = known.where(~held_out(F.col("id"))).join(columns(docs, id_col).toDF("id").distinct(), "id", "left_semi")
    known = stored(known, "labelled")
    count = known.groupBy("y").agg(F.count("*").alias("rows"))
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    return picks[0].unionByName(picks[1]).join(F.broadcast(count), "y").select("id", "y", "rows")


def held_out(doc_id):
    """The fifth of the ids that is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def telling_terms(labelled: DataFrame, sizes: dict[int, int]) -> list[str]:
    """All terms of rows (y, terms) whose likelihood ratio against the label is significant; counted on the executors."""
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n0 or not n1:
        return []
    seen = labelled.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_ROWS)
    a, b, n = F.col("a"), F.col("b"), n0 + n1
    cells = ((a, (a + b) * (n1 / n)), (b, (a + b) * (n0 / n)), (n1 - a, (n - a - b) * (n1 / n)), (n0 - b, (n - a - b) * (n0 / n)))
    g = 2 * sum((F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    return [r.term for r in seen.withColumn("g", g).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "term").collect()]


class BlockMaxIndex:
    """Examples' unit vectors in blocks, with each block's largest weight per term."""

    def __init__(self, vectors: list[dict[int, float]], ys: np.ndarray, weights: np.ndarray, terms: int):
        # Examples with like leading terms share blocks, which tightens the bounds.
        order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i], key=vectors[i].get, default=-1), sorted(vectors[i]), i))
        self.order = np.array(order, np.int64)
        self.ys, self.weights = ys[self.order], weights[self.order]
        self.blocks = -(-len(order) // BLOCK)
        dense = np.zeros((terms, self.blocks * BLOCK), np.float32)
        for place, i in enumerate(order):
            for t, w in vectors[i].items():
                dense[t, place] = w
        self.dense = dense
        self.bounds = dense.reshape(terms, self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((terms, 0), np.float32)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k examples of largest cosine above 0, exactly; ties go to lower places. but: a place left out."""
        bounds = weights @ self.bounds[terms]
        places, cosines, kth = [], [], 0.0
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or bounds[block] < kth - 1e-6:
                break
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            scores = weights @ self.dense[terms, at]
            if at.start <= but < at.stop:
                scores[but - at.start] = 0
            hit = np.flatnonzero(scores > 0)
            places.append(hit + at.start)
            cosines.append(scores[hit])
            if sum(map(len, cosines)) >= k:
                p, c = np.concatenate(places), np.concatenate(cosines)
                best = np.lexsort((p, -c))[:k]
                places, cosines, kth = [p[best]], [c[best]], c[best[-1]]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        p, c = np.concatenate(places), np.concatenate(cosines)
        best = np.lexsort((p, -c))[:k]
        return p[best], c[best]


class NeighbourVotes:
    """The fitted model: terms, frequencies, index and calibration. Equal texts get equal scores."""

    def __init__(self, terms: list[str], frequency: np.ndarray, documents: int, examples: list[tuple[int, int, list[int], list[int]]], rows: dict[int, int]):
        self.places = {t: i for i, t in enumerate(terms)}
        self.idf = np.log((1 + documents) / (1 + frequency)) + 1
        ys = np.array([e[1] for e in examples], np.int64)
        taken = Counter(ys.tolist())
        each = np.array([rows[y] / taken[y] for y in ys.tolist()], float)
        self.ids = [e[0] for e in examples]
        self.base = float((each * ys).sum() / each.sum()) if len(ys) else 0.0
        vectors = [dict(zip(t.tolist(), w.tolist())) for t, w in (self.vector(e[2], e[3]) for e in examples)]
        self.index = BlockMaxIndex(vectors, ys, each, len(terms))
        raw = np.array([self.vote(*self._items(vectors[i]), but=place) for place, i in enumerate(self.index.order.tolist())])
        self.steps = isotonic(raw, self.index.ys, self.index.weights) if len(raw) else (np.zeros(1), np.zeros(1))

    @staticmethod
    def _items(vector: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        return np.array(list(vector), np.int64), np.array(list(vector.values()), np.float32)

    def vector(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(terms, np.int64)
        w = (1 + np.log(np.array(counts, float))) * self.idf[t] if len(t) else np.zeros(0)
        return t, (w / np.sqrt((w * w).sum()) if len(t) else w).astype(np.float32)

    def vote(self, terms: np.ndarray, weights: np.ndarray, but: int = -1) -> float:
        """Distance-weighted share of label 1 among the neighbours, drawn to the base rate where they are few or far."""
        near, cosines = self.index.nearest(terms, weights, but=but) if len(terms) else ((), np.zeros(0))
        if not len(near):
            return -1.0
        share = cosines.astype(float) ** 2 * self.index.weights[near] / self.index.weights.max()
        return float((share @ self.index.ys[near] + PRIOR * self.base) / (share.sum() + PRIOR))

    def calibrated(self, raw: float) -> float:
        edges, values = self.steps
        return float(np.interp(raw, edges, values))

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[tuple[int, float, int]]]:
        """Calibrated score, and as evidence the nearest examples' ids, cosines and labels."""
        t, w = self.vector(terms, counts)
        near, cosines = self.index.nearest(t, w) if len(t) else ((), ())
        evidence = [(self.ids[self.index.order[p]], round(float(c), 6), int(self.index.ys[p])) for p, c in zip(near[:3], cosines[:3])]
        return self.calibrated(self.vote(t, w)), evidence


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising step fit of y to x by pooling adjacent violators, as points to interpolate between; each step has one pseudo-row of the mean."""
    mean = float((w * y).sum() / w.sum())
    pools: list[list[float]] = []
    for v in np.unique(x):
        at = x == v
        pools.append([float((w * y)[at].sum()), float(w[at].sum()), float(v), float(v)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], high]
    unit = float(w.mean())
    edges = [e for p in pools for e in (p[2], p[3])]
    values = [(p[0] + unit * mean) / (p[1] + unit) for p in pools for _ in (0, 1)]
    return np.array(edges), np.maximum.accumulate(np.clip(values, 0.0, 1.0))


def _counted(places: dict[str, int]) -> Callable[[list], dict]:
    stems = {n: {t[:-1]: p for t, p in places.items() if len(t) == n + 1 and t[-1] == "~"} for n in STEMS}

    def one(text: str) -> Counter:
        plain = [w.strip(_EDGES) for w in words(text)]
        found = [p for w in plain if (p := places.get(w)) is not None]
        for n, known in stems.items():
            if known:
                found += [p for w in plain if (p := known.get(w[:n])) is not None and len(w) > n]
        return Counter(found)

    def apply(texts: list[str]) -> dict:
        found = [one(t) for t in texts]
        return {"terms": [list(c.keys()) for c in found], "counts": [list(c.values()) for c in found]}

    return apply


def fit_votes(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str) -> tuple[NeighbourVotes, DataFrame]:
    """The model, and the term counts of all documents (id, terms, counts), from which its frequencies come."""
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("body"))
    sample = stored(sample_labels(docs, labels, label, id_col), "sample")
    counts = {r.y: r.rows for r in sample.select("y", "rows").distinct().collect()}
    # At most 2 * EXAMPLES ids are broadcast; a repeated id is learned from once.
    learned = rows.join(F.broadcast(sample), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("body").alias("body"))
    learned = stored(_once(stored(map_texts(learned, "body", _presence, "terms array<string>, m1 long, m2 long"), "learned")), "learned")
    terms = telling_terms(learned, {r.y: r["count"] for r in learned.groupBy("y").count().collect()})

    places = {t: i for i, t in enumerate(terms)}
    vectors = stored(map_texts(rows, "body", lambda: _counted(places), "terms array<int>, counts array<int>"), "vectors")
    frequency = np.zeros(len(terms))
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        frequency[r.t] = r.n
    examples = vectors.join(F.broadcast(sample), "id").groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct("terms", "counts")).alias("v"))
    got = sorted((r.id, r.y, r.v.terms, r.v.counts) for r in examples.collect())
    return NeighbourVotes(terms, frequency, vectors.count(), got, counts), vectors


def _remembering(model: NeighbourVotes) -> Callable[[list[int], list[int]], tuple[float, list]]:
    """The model's score, remembered for the term counts that a task has met."""
    known: dict[bytes, tuple[float, list]] = {}

    def one(terms: list[int], counts: list[int]) -> tuple[float, list]:
        pairs = sorted(zip(terms, counts))
        key = xxhash.xxh128_digest(np.array(pairs, np.int64).tobytes())
        if key not in known:
            if len(known) > 50_000:
                known.clear()
            known[key] = model.score([t for t, _ in pairs], [c for _, c in pairs])
        return known[key]

    return one


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, evidence (array of id, cosine, label).

    A text without any term, empty and null ones included, gets the rate of label 1 among such examples; long texts are
    counted whole, and of equally near examples those of lower places vote. Without examples of both
    labels every score is the base rate. Equal texts get equal scores. Repeated rows are scored alike, null ids
    count as the id ''. Other columns are ignored. No rows give no rows.
    """
    model, _ = fit_votes(docs, labels, label, id_col, text_col)
    carried = docs.sparkSession.sparkContext.broadcast(model)
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("body"))

    def make():
        one, count = _remembering(carried.value), _counted(carried.value.places)

        def apply(texts):
            counted = count(texts)
            found = [one(t, c) for t, c in zip(counted["terms"], counted["counts"])]
            return {"score": [f[0] for f in found], "evidence": [[dict(zip(("id", "cosine", "label"), e)) for e in f[1]] for f in found]}

        return apply

    # Counted anew from the texts: their tasks are as many as the table needs, where those of the small counts would be few.
    scored = map_texts(rows, "body", make, "score double, evidence array<struct<id:long,cosine:double,label:int>>")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, as score_documents has it; each row is decided by its own text, no text is shuffled."""
    model, _ = fit_votes(docs, labels, label, id_col, text_col)
    carried = docs.sparkSession.sparkContext.broadcast(model)
    named = [f"c{i}" for i in range(len(docs.columns))]
    text_at = named[docs.columns.index(text_col)]

    def make():
        one = _remembering(carried.value)
        count = _counted(carried.value.places)

        def apply(texts):
            found = count([t or "" for t in texts])
            return {"score": [one(t, c)[0] for t, c in zip(found["terms"], found["counts"])]}

        return apply

    return map_texts(docs.toDF(*named), text_at, make, "score double", drop=False).where("score < 0.5").select(*named).toDF(*docs.columns)
