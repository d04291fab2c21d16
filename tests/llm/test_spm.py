import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quirel.llm import queries, spm

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "  a  b ", "a\n\tb\x00c", "▁x", "▁", "a▁▁b ▁ c", "é ﬁ ①", "<s>hi</s>", "日本語🙂", "<unk> <0x41>", " lead", "trail  ", "\n", "a" * 30000, "x y " * 9000]


def ints(b):
    return np.frombuffer(b, "<i4").tolist()


def test_ids_equal_the_library_and_spans_cover_the_text():
    encoder = spm.OffsetEncoder(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL, add_eos=True)
    found = encoder.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        ids, begins, ends = (ints(found[k][i]) for k in ("ids", "begins", "ends"))
        assert ids == library.encode(t) and found["ids_text"][i] == " ".join(map(str, ids)) and found["n_tokens"][i] == len(ids)
        data = t.encode()
        assert b"".join(data[a:b] for a, b in zip(begins, ends)) == data
        assert begins[1:] == ends[:-1]


def _darts(entries):
    """A double-array trie in the compiled form, for a few keys (bytes) with values."""
    keys = sorted(entries)
    units, used = {0: 0}, {0}

    def place(node, keys, depth):
        groups = {}
        for k in keys:
            groups.setdefault(k[depth] if depth < len(k) else 0, []).append(k)
        base = 1
        while any((base ^ c) in used for c in groups) or base in used:
            base += 1
        used.add(base)
        for c in groups:
            used.add(base ^ c)
        units[node] = units.get(node, 0) | ((node ^ base) << 10) | ((1 << 8) if 0 in groups else 0)
        for c, below in groups.items():
            if c == 0:
                units[base] = entries[below[0]] | 0x80000000
            else:
                units[base ^ c] = c
                place(base ^ c, below, depth + 1)

    place(0, keys, 0)
    return np.array([units.get(i, 0xFFFFFFFF & 0x800000FF) for i in range(max(units) + 1)], "<u4").tobytes()


def test_longest_prefix_normalisation_keeps_places():
    strings = b"A\0fi\0\0"
    trie = _darts({"①".encode(): 2, "①x".encode(): 0, "ﬁ".encode(): 2, "ﬁy".encode(): 5})
    encoder = spm.OffsetEncoder(MODEL)
    encoder.map = spm.CharMap(len(trie).to_bytes(4, "little") + trie + strings)
    assert encoder.map.longest("①xz".encode(), 0) == (4, b"A")
    assert encoder.map.longest("①z".encode(), 0) == (3, b"fi")
    assert encoder.map.longest(b"z", 0) is None
    normal, source = encoder.normalise("b ①x ﬁyc")
    assert normal == "▁b▁A▁c"
    assert source.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 6, 6, 6, 11, 12]
    found = encoder.encode(["b ①x ﬁyc"])
    data = "b ①x ﬁyc".encode()
    spans = list(zip(ints(found["begins"][0]), ints(found["ends"][0])))
    assert spans[-1] == (len(data), len(data)) and spans[0][0] == 0 and [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]]


def test_charmap_of_the_library(tmp_path):
    try:
        normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", remove_extra_whitespaces=False, add_dummy_prefix=False, escape_whitespaces=False)
        blob = sentencepiece.sentencepiece_model_pb2.ModelProto.FromString(normalizer.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    except Exception:
        pytest.skip("the library has no compiled map of its own here")
    if not blob:
        pytest.skip("no map")
    encoder = spm.OffsetEncoder(MODEL)
    encoder.map, encoder.prefix = spm.CharMap(blob), False
    for t in ["ﬁne ①②", "ＡＢＣ　d", "éx", "ｶﾞ"]:
        assert encoder.normalise(t)[0].replace("▁", " ") == normalizer.normalize(t)


def test_query_equals_brute_force(spark, sf_dir):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL, add_eos=True)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op7_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_clashes(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a b")], "doc_id long, text string").withColumns({"id": F.lit("x"), "ids": F.lit(1), "body": F.lit(2)})
    rows = spm.decode(spm.encode(docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 1, ""), (1, 1, ""), (1, 1, ""), (2, 3, "a b")]
    assert spm.encode(docs.where("false"), MODEL, spans=False).collect() == []
