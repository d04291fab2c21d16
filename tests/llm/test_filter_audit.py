import random
import re
from itertools import permutations

import duckdb
import pytest

from quirel.llm import filter_audit, queries

DOC, LABEL = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text))
    return sum(1 << i for i, f in enumerate(fails) if f)


def plain_audit(docs, labels):
    """Every order is walked document by document."""
    masks = []
    for i, text, lang in docs:
        least = min((j for j, t, _ in docs if j is not None and (t or "") == (text or "")), default=None)
        copy = i is not None and least < i
        flags = [any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2)]
        masks.append((lang or "", plain_mask(text or "") + (16 if copy else 0), *flags))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                gone, stay = [m for m in left if m[1] & bit], [m for m in left if not m[1] & bit]
                shapley[x] += len(gone)
                out[part, order, step] = [len(stay), len(gone), sum(1 for m in mine if m[1] & bit) - len(gone), sum(m[1] == bit for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), x]
                left = stay
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return out


def audited(spark, docs, labels, extra=False):
    docs, labels = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    if extra:
        docs = docs.selectExpr("*", "1 AS mask", "2 AS good", "3 AS part", "'x' AS digest", "4 AS of", "5 AS id", "6 AS quality")
        labels = labels.selectExpr("*", "'y' AS lang", "'z' AS text", "9 AS good")
    rows = filter_audit.audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "a" * 300_000, "w " * 250, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i} #" for i in range(150)), "Ünïcode É " * 120]
    texts += [" ".join(rng.choice(["one", "Two", "THREE", "4#", "fünf"]) + str(rng.randrange(200)) for _ in range(rng.choice([10, 199, 200, 201, 300]))) for _ in range(30)]
    docs = [(i if i % 17 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(n)]
    docs += [(7, "same", "en"), (7, "same", "en"), (7, "other", "de"), (3, "same", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_equals_orders_walked_one_by_one(spark):
    docs, labels = corpus()
    want = plain_audit(docs, labels)
    assert audited(spark, docs, labels) == audited(spark, docs, labels, extra=True) == want
    assert {k[0] for k in want} == {"en", "de", "fr", ""}


def test_many_copied_texts(spark, monkeypatch):
    docs, labels = corpus(90, 6)
    docs += [(1000 + i, "hot", "en") for i in range(60)] + [(2000 + i // 2, f"pair {i // 2 % 20}", "de") for i in range(60)]
    want = plain_audit(docs, labels)
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 5)
    assert audited(spark, docs, labels) == want


def test_empty_tables_and_no_labels(spark):
    assert audited(spark, [], []) == {}
    found = audited(spark, [(1, "x", "en")], [])
    assert len(found) == 600 and found["en", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_transform_is_inverted_exactly(spark):
    rng = random.Random(1)
    masks = [(rng.randrange(32),) for _ in range(1000)]
    row = filter_audit.parity_sums(spark.createDataFrame(masks, "mask int").selectExpr("mask", "1 AS k"), "k").select("sums", filter_audit.cells(filter_audit.F.col("sums")).alias("cells")).first()
    assert row.sums[0] == 1000 and row.cells == [sum(m == i for (m,) in masks) for i in range(32)]


@pytest.mark.parametrize("name,tables", [("op11_filter_audit", ("documents", "labels")), ("op12_centroids", ("embeddings",)), ("op13_url_rules", ("pages",))])
def test_queries_match_their_sql(spark, sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frames = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    got, want = (f[sorted(f.columns)].astype(str).sort_values(sorted(f.columns)).reset_index(drop=True) for f in frames)
    assert len(got) and got.equals(want)
