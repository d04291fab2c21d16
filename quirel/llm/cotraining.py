"""Quality by co-training: a classifier of the words and one of the page's metadata teach each other.

Both start from a bounded sample of labelled rows. In each round either one labels the pool documents of which
it is most sure, and the other learns those as well. At the end both are calibrated on labelled rows
that neither was fitted to, and their calibrated odds are added to score all documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_texts, stored, text_or_empty
from .toxicity import held_out, sample_labels

#: Labelled rows of a label, pool rows, word buckets: together they bound what is fitted on the driver.
EXAMPLES, POOL, BUCKETS = 1500, 3000, 4096
ROUNDS, SURE = 4, 0.12
#: The share of the labelled sample that calibrates.
CALIBRATE = 4

#: The measures of page_shape, in order.
SHAPES = ("log length", "log words", "log lines", "word length", "letters", "digits", "marks", "upper", "spaces", "ends of sentences", "odd word ends", "repeated lines", "pipes", "log line length")


def word_buckets(text: str) -> tuple[list[int], list[float]]:
    """Buckets of the lower-cased words with damped counts, scaled to length one."""
    counts: dict[int, int] = Counter()
    for w, n in Counter(text.lower().split()).items():
        counts[zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS] += n
    if not counts:
        return [], []
    values = [1 + math.log(n) for n in counts.values()]
    scale = 1 / math.sqrt(sum(v * v for v in values))
    return list(counts), [v * scale for v in values]


_CLASSES = bytes((117 if 65 <= i <= 90 else 108 if 97 <= i <= 122 or i >= 128 else 100 if 48 <= i <= 57 else 32 if i in (9, 10, 11, 12, 13, 32) else 46 if i in (33, 46, 63) else 44 if i in (34, 39, 40, 41, 44, 45, 58, 59) else 124 if i == 124 else 35) for i in range(256))


def page_shape(text: str, lang: str | None, source: str | None) -> list[float]:
    """Metadata of a page: its measures, and 16 buckets each for its language and source. Words as such aren't looked at."""
    data = text.encode("utf-8", "replace")
    kinds = data.translate(_CLASSES)
    n = max(1, len(data))
    blanks = kinds.count(b" ")
    word_count = len(data.split())
    lines = text.split("\n")
    share = lambda *of: sum(kinds.count(c) for c in of) / n
    odd = kinds.count(b"## ") + kinds.count(b"#") - kinds.count(b" #")
    measures = [
        math.log1p(n), math.log1p(word_count), math.log1p(len(lines)), min(30.0, n / max(1, word_count)), share(b"l"), share(b"d"), share(b"#"), share(b"u"), blanks / n, share(b"."),
        odd / max(1, word_count), 1 - len(set(lines)) / len(lines), share(b"|"), math.log1p(n / len(lines)),
    ]
    named = [0.0] * 32
    named[zlib.crc32((lang or "").encode()) % 16] = 1.0
    named[16 + zlib.crc32((source or "").encode()) % 16] = 1.0
    return measures + named


class Logistic:
    """Ridge logistic regression over sparse rows, fitted by Adam with weights per row."""

    def __init__(self, size: int, ridge: float):
        self.w, self.bias, self.ridge, self.size = np.zeros(size), 0.0, ridge, size

    def raw(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.w) + self.bias

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 120) -> Logistic:
        weight = weight / weight.sum()
        m = v = np.zeros(self.size + 1)
        for step in range(1, steps + 1):
            off = weight * (1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30))) - y)
            slope = np.append(rows.transposed(off, self.size) + self.ridge * self.w, off.sum())
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            self.w, self.bias = self.w - move[:-1], self.bias - move[-1]
        return self


class Rows:
    """Sparse rows: starts, places and values."""

    def __init__(self, places: list, values: list):
        self.lengths = np.array([len(p) for p in places], np.int64)
        self.owner = np.repeat(np.arange(len(places)), self.lengths)
        self.places = np.concatenate([np.asarray(p, np.int64) for p in places]) if places else np.zeros(0, np.int64)
        self.values = np.concatenate([np.asarray(v, float) for v in values]) if values else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=self.values * w[self.places], minlength=len(self.lengths)) if len(self.lengths) else np.zeros(0)

    def transposed(self, off: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.places, weights=self.values * off[self.owner], minlength=size)


class CoTrained:
    """The two fitted views with their calibrations; score() takes a page's words and shape."""

    def __init__(self, labelled: list, pool: list):
        """labelled: (y, weight, places, values, shape) in a fixed order; pool: (places, values, shape)."""
        shapes = np.array([r[4] for r in labelled] + [r[2] for r in pool], float)
        self.mean, self.scale = shapes.mean(axis=0), np.maximum(shapes.std(axis=0), 1e-3)
        ys, weights = np.array([r[0] for r in labelled], float), np.array([r[1] for r in labelled], float)
        self.base = float((ys * weights).sum() / weights.sum())
        keep = np.arange(len(labelled)) % CALIBRATE == 0
        learn, check = np.flatnonzero(~keep), np.flatnonzero(keep)
        text_rows = lambda at: Rows([labelled[i][2] for i in at], [labelled[i][3] for i in at])
        every = self.standard(shapes)
        n = len(labelled)
        new = {0: {}, 1: {}}
        self.views = [Logistic(BUCKETS, 1e-4), Logistic(shapes.shape[1], 1e-3)]
        pool_rows = (Rows([p[0] for p in pool], [p[1] for p in pool]), self.dense(every[n:]))
        for turn in range(ROUNDS + 1):
            for view, model in enumerate(self.views):
                taught = sorted(new[view])
                y = np.append(ys[learn], [new[view][i] for i in taught])
                w = np.append(weights[learn], [0.3 * weights[learn].mean()] * len(taught))
                if view == 0:
                    rows = Rows([labelled[i][2] for i in learn] + [pool[i][0] for i in taught], [labelled[i][3] for i in learn] + [pool[i][1] for i in taught])
                else:
                    rows = self.dense(np.concatenate([every[learn], every[[n + i for i in taught]]]) if taught else every[learn])
                model.fit(rows, y, w, 120 if turn == 0 else 40)
            if turn < ROUNDS and pool:
                for view, model in enumerate(self.views):
                    raw = model.raw(pool_rows[view])
                    order = np.argsort(raw, kind="stable")
                    # As many of either label as the base rate has, so that pseudo-labels keep the balance.
                    k1 = int(len(pool) * SURE / ROUNDS * self.base)
                    k0 = int(len(pool) * SURE / ROUNDS * (1 - self.base))
                    for i in [int(x) for x in order[::-1] if int(x) not in new[1 - view]][:k1]:
                        if raw[i] > 0:
                            new[1 - view][i] = 1
                    for i in [int(x) for x in order if int(x) not in new[1 - view]][:k0]:
                        if raw[i] < 0:
                            new[1 - view][i] = 0
        self.exchanged = len(new[0]), len(new[1])
        raws = [self.views[0].raw(text_rows(check)), self.views[1].raw(self.dense(every[check]))]
        self.slopes = [self._calibrate(r, ys[check], weights[check]) for r in raws]
        both = sum(a * r + b for (a, b), r in zip(self.slopes, raws))
        self.final = self._calibrate(both, ys[check], weights[check])

    def standard(self, shapes: np.ndarray) -> np.ndarray:
        return np.clip((shapes - self.mean) / self.scale, -5, 5)

    @staticmethod
    def dense(shapes: np.ndarray) -> Rows:
        return Rows([np.arange(shapes.shape[1])] * len(shapes), list(shapes))

    @staticmethod
    def _calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
        """Slope and offset of the odds; the slope isn't negative."""
        if len(set(y.tolist())) < 2:
            return 1.0, 0.0
        scale = float(np.abs(raw).mean()) or 1.0
        model = Logistic(1, 1e-3).fit(CoTrained.dense((raw / scale)[:, None]), y, weight, 300)
        return max(0.0, float(model.w[0])) / scale, float(model.bias)

    def score(self, places: list[int], values: list[float], shape: list[float]) -> tuple[float, float, float]:
        """Combined, word and metadata scores between 0 and 1."""
        text = float(np.dot(self.views[0].w[places], values)) + self.views[0].bias if places else self.views[0].bias
        page = float(self.standard(np.array(shape)) @ self.views[1].w) + self.views[1].bias
        odds = [a * r + b for (a, b), r in zip(self.slopes, (text, page))]
        sure = lambda x: 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))
        return sure(self.final[0] * sum(odds) + self.final[1]), sure(odds[0]), sure(odds[1])


def _features() -> Callable[..., dict]:
    def apply(texts, langs, sources):
        found = [word_buckets(t) for t in texts]
        return {"places": [f[0] for f in found], "values": [f[1] for f in found], "shape": [page_shape(t, a, b) for t, a, b in zip(texts, langs, sources)]}

    return apply


def fit(docs: DataFrame, labels: DataFrame, label: str) -> CoTrained | None:
    """docs: (id, body, lang, source). The labelled sample and the pool are those that hash lowest; at most 2 * EXAMPLES + POOL rows are collected."""
    sample = stored(sample_labels(docs, labels.withColumnRenamed("doc_id", "id"), label, "id", EXAMPLES), "sample")
    if sample.select("y").distinct().count() < 2:
        return None
    ids = docs.select("id").where("id is not null").distinct().join(F.broadcast(sample), "id", "left_anti").where(~held_out(F.col("id")))
    pool = ids.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(POOL).select("id", F.lit(None).cast("int").alias("y"), F.lit(None).cast("long").alias("rows"))
    taken = stored(sample.unionByName(pool), "taken")
    rows = docs.join(F.broadcast(taken), "id").groupBy("id").agg(F.first("y").alias("y"), F.first("rows").alias("rows"), F.min(F.struct("body", "lang", "source")).alias("d")).select("id", "y", "rows", "d.*")
    found = map_texts(rows, "body", _features, "places array<int>, values array<float>, shape array<double>", also=("lang", "source"))
    got = sorted(found.collect(), key=lambda r: (r.y is None, zlib.crc32(str(r.id).encode()), r.id))
    many = Counter(r.y for r in got)
    labelled = [(r.y, r.rows / many[r.y], r.places, r.values, r.shape) for r in got if r.y is not None]
    return CoTrained(labelled, [(r.places, r.values, r.shape) for r in got if r.y is None])


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, text_score, page_score.

    Labels of the held-out fifth of the ids are never learned from, nor are those rows in the pool. Null text counts
    as empty; null language and source are values of their own. Without both labels all scores are 0.5. Rows that
    repeat are scored alike. Other columns are ignored. No rows give no rows.
    """
    rows = columns(docs, id_col, text_col, lang_col, source_col).toDF("id", "body", "lang", "source").withColumn("body", text_or_empty("body")).withColumns({c: F.col(c).cast("string") for c in ("lang", "source")})
    model = fit(rows, columns(labels, id_col, label).toDF("doc_id", label), label)
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = carried.value

        def apply(texts, langs, sources):
            found = [fitted.score(*word_buckets(t), page_shape(t, a, b)) if fitted else (0.5, 0.5, 0.5) for t, a, b in zip(texts, langs, sources)]
            return {name: [f[i] for f in found] for i, name in enumerate(("score", "text_score", "page_score"))}

        return apply

    found = map_texts(rows, "body", make, "score double, text_score double, page_score double", also=("lang", "source"))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "page_score")
