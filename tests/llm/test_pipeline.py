import hashlib
import re
from collections import Counter

import sentencepiece

import __spark_entry__
import corpus_pipeline
from quirel.llm import mixing, queries, toxicity
from tests.llm.test_similar import brute_kept


def plain(spark, sf_dir):
    """The pipeline's rows by plain Python; the first stage's votes come from the operator's model, searched exhaustively."""
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    model, _ = toxicity.fit_votes(docs, labels, "toxic", "doc_id", "text")
    index = model.index
    rows = []
    for d in docs.collect():
        found = toxicity._counted(model.places)([d.text])
        t, w = model.vector(sorted(found["terms"][0]), [c for _, c in sorted(zip(found["terms"][0], found["counts"][0]))])
        cosines = sorted(((float(w @ index.dense[t, p]), -p) for p in range(len(index.order))), reverse=True)[: toxicity.NEIGHBOURS] if len(t) else []
        near = [(c, -p) for c, p in cosines if c > 0]
        raw = -1.0
        if near:
            share = [c**2 * index.weights[p] / index.weights.max() for c, p in near]
            raw = (sum(s * index.ys[p] for s, (_, p) in zip(share, near)) + toxicity.PRIOR * model.base) / (sum(share) + toxicity.PRIOR)
        if model.calibrated(raw) < 0.5:
            rows.append(d)
    best = {}
    for d in rows:
        if d.text not in best or d.doc_id > best[d.text].doc_id:
            best[d.text] = d
    heads = set(brute_kept({d.doc_id: d.text for d in best.values()}))
    rows = [d for d in best.values() if d.doc_id in heads]
    size = {d.doc_id: len(re.findall("[^\x20\x09-\x0d]+", d.text)) for d in rows}
    total = Counter()
    for d in rows:
        total[d.source] += size[d.doc_id]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}
    rest, full = 1.5 * sum(total.values()), set()
    while True:
        each = rest / sum(w for s, w in weight.items() if s not in full)
        over = [s for s in weight if s not in full and each * weight[s] > 2 * total[s]]
        if not over:
            break
        full |= set(over)
        rest -= sum(2 * total[s] for s in over)
    rate = {s: 2.0 if s in full else each * weight[s] / total[s] for s in total}
    draw = {d.doc_id: int(hashlib.md5(f"mix:{d.doc_id}".encode()).hexdigest()[:8], 16) / 2**26 for d in rows}

    def extra(d, turn):
        return (int(draw[d.doc_id]) + turn) % 64 + draw[d.doc_id] % 1 < rate[d.source] % 1 * 64

    turns = {}
    for s in total:
        wanted = rate[s] * total[s] - int(rate[s]) * total[s]
        turns[s] = min(range(64), key=lambda t: (abs(sum(size[d.doc_id] for d in rows if d.source == s and extra(d, t)) - wanted), t))
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_model(), add_eos=True)
    out = Counter()
    for d in rows:
        ids = library.encode(d.text)
        row = d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        out[row] += int(rate[d.source]) + extra(d, turns[d.source])
    return +out


def test_run_equals_plain_version(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == plain(spark, sf_dir)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.names == docs.columns
    assert "pipeline" in __spark_entry__.queries()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_mixed_emits_what_the_plan_takes(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in mixing.mixed(docs).collect()) == +Counter(plan)
