import hashlib

import numpy as np
import pytest

from tidemark.llm import op7_suffix_dedup as p7
from tidemark.llm.rindex import RunIndex


def brute(rows, window=50):
    big = 1 << 62
    first = {}
    raw = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            first[w] = min(first.get(w, big + 1), d)
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if first[t[i : i + window]] < d:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((-1 if d == big else d, len(t), int(gone.sum()), spans, kept))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, sum(x.end - x.start for x in r.removed) + len(r.kept), sum(x.end - x.start for x in r.removed), len(r.removed), bytes(r.kept)) for r in df.collect())


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        parts = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(rng.integers(1, 12))]
        text = np.concatenate([np.append(p, 0) for p in parts])
        p = rng.integers(1, 5, (10, 20))
        ms, at = RunIndex(text, 32).matching_statistics(p)
        subs = {tuple(text[i : i + n]) for i in range(text.size) for n in range(21)}
        for r in range(10):
            for c in range(20):
                k = 0
                while c + k < 20 and tuple(p[r, c : c + k + 1]) in subs:
                    k += 1
                assert ms[r, c] == k


@pytest.mark.parametrize("indexed", [3 << 20, 400])
def test_repeats(spark, monkeypatch, indexed):
    monkeypatch.setattr(p7, "INDEXED", indexed)
    rng = np.random.default_rng(1)
    say = lambda n, a="abcdefghij é": "".join(rng.choice(list(a), n))
    line = say(70)
    rows = [(i, say(40) + line[: rng.integers(45, 70)] + say(60) + line[rng.integers(0, 25) :] + say(rng.integers(0, 30))) for i in range(60)]
    rows += [(100 + i, rows[i][1][rng.integers(0, 20) :] + say(20)) for i in range(30)]
    rows += [(200, "a" * 500), (201, "a" * 49 + "b"), (202, "b" + "a" * 300), (203, "ab" * 100), (204, "b" * 49), (205, None), (206, ""), (7, line), (7, line), (None, line), (None, rows[3][1])]
    rows += [(300 + i, say(80, "xy")) for i in range(40)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    assert rows_of(p7.deduplicate(docs)) == brute(rows)
    assert p7.deduplicate(docs.limit(0)).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [(d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute(rows)]
    assert sorted(tuple(r) for r in p7.query(spark, "/root/testdata/sf0.001").collect()) == want


def test_long_documents_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefgh "), 5000))
    whole = p7.Slice([1], [text], 4, 50, 20)
    monkeypatch.setattr(p7, "LONG", 2000)
    monkeypatch.setattr(p7, "STRETCH", 1300)
    cut = p7.Slice([1], [text], 4, 50, 20)  # four stretches
    for s in (whole, cut):
        starts = sorted(x for a, z in zip(s.a.tolist(), s.z.tolist(), strict=True) for x in range(a, z + 1))
        assert starts == list(range(4951))
    assert cut.h.size > whole.h.size - 1 and set(zip(whole.h.tolist(), (whole.p).tolist(), strict=True)) == set(zip(cut.h.tolist(), (cut.p).tolist(), strict=True))


def test_repeats_across_stretches(spark, monkeypatch):
    """In this process: step 1 on long texts and on short ones that hold their pieces, judged by brute force."""
    rng = np.random.default_rng(4)
    say = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    long = say(3000)
    rows = [(1, long), (2, say(30) + long[700:1500] + say(40)), (3, long[1250:1350]), (4, say(90)), (5, long + say(60))]
    for name, value in (("STEP", 600), ("LONG", 1000), ("STRETCH", 500)):  # stretches are of single texts
        monkeypatch.setattr(p7, name, value)
    s = p7.Slice([d for d, _ in rows], [t for _, t in rows], 1, 50, 20)
    first = {}
    for h, c, doc, a, z in zip(s.h.tolist(), s.c.tolist(), s.doc.tolist(), s.a.tolist(), s.z.tolist(), strict=True):
        first.setdefault(h, []).append((doc, a, z, c))
    covered = {(doc, x) for own in first.values() for doc, a, z, _ in own for x in range(a, z + 1)}
    assert covered == {(i, x) for i, (_, t) in enumerate(rows) for x in range(max(0, len(t.encode()) - 49))}


@pytest.mark.parametrize("size", [1 << 24, 600])
def test_slices_follow_the_bytes(spark, monkeypatch, size):
    monkeypatch.setattr(p7, "SLICE", size)
    rows = [(i, ("shared passage of words that goes on and on for a good while " if i % 3 else "") + f"row {i} " * 8) for i in range(40)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    assert rows_of(p7.deduplicate(docs)) == brute(rows)
