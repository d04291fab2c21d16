import hashlib
import math
import random
import struct

import pytest

from quirel.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=16, rounds=3, size=64):
    kept = [(i, [int(x) * 64 if abs(x) >= 2**53 else math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    points = [v for i, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in points]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = [a for a, _ in assign()]
        for c in range(len(points)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                points[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found, most = assign(), 2**63 - 1
    total = lambda c: sum(min(d, most) for a, d in found if c in (None, a))
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, a, min(d, most), min(total(a), most), min(total(None), most), sha[a]) for (i, _), (a, d) in zip(kept, found)), key=str)


def clustered(table):
    return sorted(map(tuple, centroids.cluster_vectors(table).collect()), key=str)


def cases(seed=3, n=300):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [struct.unpack("f", struct.pack("f", x + rng.gauss(0, 0.1)))[0] for x in rng.choice(middle)]) for i in range(n)]
    rows += [(None, [0.5] * 64), (None, [-0.5] * 64), (7, [0.25] * 64), (7, [0.25] * 64), (8, [-0.0] * 64)]
    rows += [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [math.nan] + [0.0] * 63), (905, [math.inf] + [0.0] * 63), (906, [None] + [0.0] * 63)]
    return rows


def test_equals_plain_lloyd(spark):
    rows = cases()
    table = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    extra = table.repartition(7).selectExpr("*", "1 AS cluster", "'x' AS vector", "2 AS id", "3 AS distance", "4 AS digest")
    assert clustered(table) == clustered(extra) == want
    assert len(want) == 305 and len({r[1] for r in want}) > 3


@pytest.mark.parametrize("large", [2.0**22, 1e12, 3.4e38, 1.7e308])
def test_large_components_are_exact(spark, large):
    rows = [*cases(4, 60), (500, [large] * 64), (501, [-large] * 64), (502, [large, *[1.0] * 63])]
    assert clustered(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_few_equal_and_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [0.5] * 64), (2, [1.5] * 64)], [(i, [0.5] * 64) for i in range(40)]):
        assert clustered(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
