import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import encoder
from tidemark.llm.common import tokenizer_path
from tidemark.llm.op1_bpe_chunks import chunk_ends, decode, encode, encode_with


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["", " ", "a", "wörd. naïve, x's y'. ß!! ª º µ-- ³x ÿ", "it's't ''s 1st 2.5, a.b", "İstanbul ΣΑΣ <|endoftext|> x", "éa don't I'LL 12345", "x" * 40_000, "<|ENDOFTEXT|> a\x1cb\x85c d", "日本語 テスト 😀!!"]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_library(text):
    assert encoder(tokenizer_path()).encode(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_odd_texts():
    t, e = library(), encoder(tokenizer_path())
    for x in ODD:
        ids = t.encode(x, add_special_tokens=False).ids
        assert e.encode(x).tolist() == ids
        assert e.decode(ids) == t.decode(ids, skip_special_tokens=False)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab 'stll1.\n", min_size=1, max_size=400), st.lists(st.integers(0, 399), max_size=6), st.booleans())
def test_joins_are_repaired(text, cuts, odd):
    e = encoder(tokenizer_path())
    cuts = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    known = [(a, b, e.encode(text[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if i % 2 == odd]
    assert encode_with(e, text, known).tolist() == e.encode(text).tolist()


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    body = " ".join(word() for _ in range(4000))
    cut = lambda t: {t[a:b] for a, b in zip([0, *chunk_ends(t)], chunk_ends(t))}
    assert "".join(body[a:b] for a, b in zip([0, *chunk_ends(body)], chunk_ends(body))) == body
    assert len(cut(body) & cut("some other start " + body)) > 0.8 * len(cut(body))


def test_operator(spark):
    rng = np.random.default_rng(2)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(1500))
    texts = [*ODD, None, passage, passage, "prefix words " + passage[500:], passage[:7000] + "Tail"]
    rows = [(i, x, "clash") for i, x in enumerate(texts)] + [(3, ODD[3], "x"), (None, passage, "x"), (3, passage, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    t = library()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids, r.decoded) for r in decode(encode(docs)).collect())
    want = []
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, ids, t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert sorted(map(str, encode(docs, decoded=True).collect())) == sorted(map(str, decode(encode(docs)).collect()))
    assert encode(docs.limit(0)).count() == 0


def test_query_is_brute_force(spark):
    from tidemark.llm.op1_bpe_chunks import query

    t = library()
    src = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in query(spark, "/root/testdata/sf0.001").collect():
        ids = t.encode(src[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_many_equal_rows_cost_no_more_than_others(spark):
    import time

    from pyspark.sql import functions as F

    from tidemark.llm import op1_bpe_chunks as p1

    text = " ".join(f"some words{i} here" for i in range(1200))
    took = []
    for key in ("cast(null as long)", "id"):
        docs = spark.range(600).select(F.expr(key).alias("doc_id"), F.lit(text).alias("text"))
        start = time.time()
        got = p1.encode(docs).groupBy("ids").count().collect()
        took.append(time.time() - start)
        assert [r["count"] for r in got] == [600]
    assert took[0] < 8 * took[1] + 20
