import random

import corpus_pipeline
from quirel.llm import components, queries, similar, simhash
from tests.llm.test_simhash import brute_fingerprint


def shingle_set(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute_kept(texts):
    """Ids that stay, comparing all pairs."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted(k for k in root if root[k] == k)


def texts_with_copies():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = {}
    for g in range(25):
        base = [word() for _ in range(rng.randrange(30, 300))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy)
    chain = [word() for _ in range(200)]
    for _ in range(15):  # a chain whose ends aren't similar
        chain = [*chain[8:], *[word() for _ in range(8)]]
        texts[len(texts)] = " ".join(chain)
    return texts | {len(texts): "", len(texts) + 1: " \n", len(texts) + 2: "One two", len(texts) + 3: "one  two"}


def test_equals_all_pairs(spark):
    texts = texts_with_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = sorted(r.doc_id for r in similar.drop_similar(docs).collect())
    assert kept == brute_kept(texts) and len(kept) < len(texts) - 60


def test_stage_drops_copies_beyond_three_bits(spark, sf_dir):
    words = [f"w{i * i % 997}" for i in range(300)]
    far = [w if i % 60 else "other" for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(far)
    assert (brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() > 3 and brute_kept({1: a, 2: b}) == [1]
    docs = spark.createDataFrame([(2, b), (1, a)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()] == [1]


def test_stage_equals_all_pairs_on_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").dropDuplicates(["text"])
    rows = {r.doc_id: r.text for r in docs.collect()}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == brute_kept(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "quite another text of some words"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, similar.drop_similar(docs).collect())) == sorted(map(str, [docs.collect()[i] for i in (0, 1, 3, 4, 5)]))
    assert similar.drop_similar(docs.where("false")).collect() == []


def test_small_tables_are_few_files_however_many_tasks_make_them(spark, monkeypatch):
    written = {}

    def noted(*tables):
        for t in tables:
            written.setdefault(t.stored_at.rsplit("/", 1)[1][:-33], []).append(len(t.inputFiles()))

    for module in (similar, components, simhash):
        monkeypatch.setattr(module, "discard", noted)
    many = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    texts = texts_with_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        kept = sorted(r.doc_id for r in similar.drop_similar(docs).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == brute_kept(texts)
    assert {"classes", "tries", "level8", "pairs", "wanted", "stars", "tried"} <= written.keys()
    assert all(n == 1 for name, counts in written.items() if name not in ("posts", "sets", "held", "open") for n in counts), written
    assert max(written["posts"]) <= similar.POSTS
