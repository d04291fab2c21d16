import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quirel.llm import simhash
from quirel.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", lowered)]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """By id: the smallest id reachable over links of 3 bits or fewer."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one TWO", "É a B c\x0bd", " ".join(rng.choice("a b c dd É Éa".split()) for _ in range(5000))]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) % 2**64 == brute_fingerprint(t), t


def test_spark_hash_is_the_shingle_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b ç"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b ç", 42)


def test_trie_finds_all_links(spark):
    rng = random.Random(7)
    keys = {rng.getrandbits(64) for _ in range(300)}
    for k in list(keys)[:60]:
        for _ in range(6):
            keys.add(k ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    hot = rng.getrandbits(64)
    keys |= {hot ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    keys |= {0, 2**64 - 1, 7, 2**63}
    keys = sorted(keys)
    brute = {(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if (a ^ b).bit_count() <= 3}
    signed = [int(np.uint64(k).astype(np.int64)) for k in keys]
    rows = simhash.trie_links(spark.createDataFrame([(k,) for k in signed], "key long"))
    got = [tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == brute


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, -9), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, -5: -9, -9: -9}


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("x").alias("fp"), F.lit(1).alias("component_id"))
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "One"), (9005, "One")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []


def test_components_take_no_round_where_tasks_have_settled_them(spark, monkeypatch):
    from quirel.llm import components as module

    rounds = []
    stars = module._stars
    monkeypatch.setattr(module, "_stars", lambda edges, large: rounds.append(large) or stars(edges, large))
    edges = [(i, i + 1) for i in range(300) if i % 50 != 49] + [(400, 400), (7, 3), (3, 7)]
    want = {i: i // 50 * 50 for i in range(300)}
    together = spark.createDataFrame(edges, "a long, b long").repartition(1)
    # The same edges twice, in two tasks: each node is still returned once.
    for df in (together, together.union(together)):
        rows = components(df).collect()
        assert len(rows) == len(want) and {r.node: r.root for r in rows} == want
    assert rounds == []
    apart = spark.createDataFrame([(1, 2)], "a long, b long").union(spark.createDataFrame([(2, 3)], "a long, b long"))
    assert {r.node: r.root for r in components(apart).collect()} == {1: 1, 2: 1, 3: 1} and rounds
    with pytest.raises(RuntimeError):
        components(apart, rounds=0)
    assert components(apart.where("false")).collect() == []
