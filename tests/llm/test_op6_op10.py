import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import op6_quality as p6
from tidemark.llm import op10_token_counts as p10
from tidemark.llm.common import tokenizer_path


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\xa0é", max_size=80))
def test_statistics(text):
    assert p6.measure(text)[:5] == plain(text)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = p6.fit(docs, labels)
    got = {r.doc_id: r for r in p6.judge(docs, rules, "doc_id").collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        want = plain(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)
    good = [got[r.doc_id] for r in labels.filter("quality = 1").collect()]
    good = [g for g in good if not g.base_failed]
    assert sum(g.kept for g in good) >= 0.98 * len(good)


def test_learning_finds_conjunctions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 11))
    y = ((x[:, 2] > 0.7) & (x[:, 5] <= 0.4)) | (x[:, 7] > 0.95)
    rules = p6.learn(x, y)
    test = rng.random((3000, 11))
    truth = ((test[:, 2] > 0.7) & (test[:, 5] <= 0.4)) | (test[:, 7] > 0.95)
    found = np.zeros(3000, bool)
    for r in rules:
        found |= p6._holds(test, r)
    assert (found & truth).sum() > 0.8 * truth.sum()
    assert (found & ~truth).sum() < 0.05 * max(1, found.sum())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (None, "w " * 60, 2), (1, "", 2)], "doc_id long, text string, n_words int")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert p6.fit(docs, empty) == []
    assert [(r.doc_id, r.base_failed, r.kept) for r in p6.judge(docs, [], "doc_id").collect()] == [(1, True, False), (None, True, False), (1, True, False)]
    assert p6.judge(docs.limit(0), []).count() == 0


def test_verdicts_are_the_list_read_in_order(spark):
    """Every row against its rules one by one, from statistics made here."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = p6.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert rules
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in p6.judge(docs, rules, "doc_id").collect():
        cols = {c: np.array([v]) for c, v in zip(p6.STATS, p6.measure(texts[r.doc_id]), strict=True)}
        bad = plain(texts[r.doc_id])[0] < 50 or 100 * plain(texts[r.doc_id])[4] > 50 * plain(texts[r.doc_id])[0]
        for rule in rules:
            if not bad:
                bad = all((p6.features()[f][1](cols)[0] > t) == up for f, up, t in rule)
        assert r.kept == (not bad)


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(i % 4, f"{text} {i % 8}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(p6, "learn", lambda x, y: seen.append((x, y)) or [])
    p6.fit(docs, labels, rows=6)
    p6.fit(docs.repartition(7), labels.repartition(5), rows=6)
    assert len(seen[0][1]) == 5 and np.array_equal(seen[0][0], seen[1][0]) and np.array_equal(seen[0][1], seen[1][1])  # contradicting labels both stay


def counter():
    return p10._counter(tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 'stll1.\n", max_size=300), st.lists(st.tuples(st.integers(-5, 320), st.integers(0, 60), st.text(alphabet="ab \n's", max_size=30)), max_size=8))
def test_tree_equals_recount(text, edits):
    count = counter()
    tree = p10.Tree(text, count, 16)
    for at, remove, insert in edits:
        tree.edit(at, remove, insert)
        at = min(max(at, 0), len(text))
        text = text[:at] + insert + text[at + remove :]
        assert tree.text() == text
        assert tree.tokens == count(text)
        assert tree.chars == len(text)


def depth(root):
    return 0 if root is None else 1 + max(depth(root.left), depth(root.right))


def test_the_tree_stays_low():
    tree = p10.Tree("word " * 40_000, lambda t: len(t.split()), 16)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        tree.edit(int(rng.integers(tree.chars)) if rng.random() < 0.5 else tree.chars, int(rng.integers(30)), " one two three four")
    assert tree.tokens == len(tree.text().split()) and tree.root.leaves > 8000
    assert depth(tree.root) < 60
    for x in tree.nodes(tree.root):
        own = list(tree.nodes(x))
        assert len(own) > 50 or (x.tokens, x.chars, x.leaves) == (sum(y.own for y in own), sum(len(y.text) for y in own), len(own))


def test_work_follows_the_edit():
    count = counter()
    tree = p10.Tree("some words here " * 20_000, count)
    tree.edit(150_000, 3, "x")
    assert 0 < tree.encoded < 4 * p10.LEAF


def test_recount(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    n = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    for r in p10.query(spark, "/root/testdata/sf0.001").limit(60).collect():
        assert r.n_tokens > 0
    src = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in p10.query(spark, "/root/testdata/sf0.001").collect():
        s = src[r.doc_id]
        assert r.n_tokens == n(s)
        m = len(s)
        s = s[: m // 3] + " revised wording, 2nd draft " + s[m // 3 :]
        s = s[: m // 2] + s[m // 2 + 24 :]
        s = s[: 2 * m // 3] + "it's" + s[2 * m // 3 + 7 :]
        assert r.n_tokens_edited == n("Re" + s)
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "x" * 5000, 5)], "doc_id long, text string, n_tokens int")
    log = spark.createDataFrame([(1, 2, 0, 0, "a"), (1, 1, 0, 0, "b c"), (2, 1, 99999, 3, None)], "doc_id long, seq int, at int, remove int, insert string")
    got = {r.doc_id: (r.text, r.n_tokens_edited) for r in p10.recount(p10.with_edits(p10.build(docs, "doc_id"), log)).collect()}
    assert got[1] == ("ab c", n("ab c")) and got[None] == ("a b", 2) and got[2][1] == n("x" * 5000)
    assert p10.build(docs.limit(0)).count() == 0
