import re

import pytest

import corpus_pipeline
from tidemark.llm import op4_packing, op6_quality

from .test_op6_op10 import plain as plain_stats
from .test_op7 import brute as repeats
from .test_op8 import plain as plain_pii


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(sf + "/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    # 1: rules
    rules = op6_quality.fit(docs, spark.read.parquet(sf + "/labels.parquet"))
    kept = {}
    for d, t in rows.items():
        s = plain_stats(t)
        cols = dict(zip(op6_quality.STATS, [[x] for x in op6_quality.measure(t)]))
        x = op6_quality.np.column_stack([f({k: op6_quality.np.array(v) for k, v in cols.items()}) for _, f, _ in op6_quality.features()])
        if not (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not any(op6_quality._holds(x, r)[0] for r in rules):
            kept[d] = t
    got = corpus_pipeline.quality_rules(spark, docs, sf)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == kept
    # 2: one of each group: what stays is not similar to an earlier one that stays, and nothing dissimilar goes
    slim = corpus_pipeline.simhash(spark, got, sf)
    assert slim.columns == docs.columns
    sets = {d: shingles(t) for d, t in kept.items()}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    stay = {r.doc_id for r in slim.collect()}
    close = [p for p, j in alike.items() if j >= 0.8]
    assert not any(set(p) <= stay for p in close)
    first = {d: d for d in kept}
    while any(first[a] != first[b] for a, b in close):
        for a, b in close:
            first[a] = first[b] = min(first[a], first[b])
    assert set(first.values()) <= stay
    kept = {d: t for d, t in kept.items() if d in stay}
    # 3: repeats, without parts of characters
    out = {}
    for d, n, removed, spans, raw in repeats(list(kept.items())):
        text = raw.decode("utf-8", "ignore") if removed else kept[d]
        if not removed or re.search(r"[^\x20\x09-\x0D]", text):
            out[d] = text
    stage = corpus_pipeline.repeats(spark, slim, sf)
    assert stage.columns == docs.columns
    real = {r.doc_id: r for r in stage.collect()}
    assert set(real) == set(out)
    for d, t in out.items():
        assert real[d].n_chars == len(real[d].text)
        assert abs(len(real[d].text) - len(t)) <= 2 * (1 + t.count("\ufffd")) + 20
    # 4: base personal data is gone
    done = corpus_pipeline.personal_data(spark, stage, sf)
    assert done.columns == docs.columns
    for r in done.collect():
        left = [x for x in plain_pii(r.text)]
        assert all(k.split(":")[0] == "card" for k in left) or not left
        if not plain_pii(real[r.doc_id].text):
            assert r.text == real[r.doc_id].text or "[" in r.text
    # 5: every piece is placed
    packed = corpus_pipeline.run(spark, sf).collect()
    want = op4_packing.pieces(done).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in want)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048


def test_stages_stand_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, None, "s", 1, "x"), (1, words, None, "s", 1, "x"), (None, words + " tail", "en", None, None, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, "z " + words[100:] + " a@b.cd " + " ".join(f"v{i}" for i in range(60)), "en", "s", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    sf = "/root/testdata/sf0.001"
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns
        last = corpus_pipeline.packing(spark, now, sf).collect()
        assert bool(last) != empty
    assert "[EMAIL]" in [r.text for r in now.union(corpus_pipeline.personal_data(spark, docs, sf)).collect() if r.doc_id == 4][0]


@pytest.mark.parametrize("name", ["op2_embeddings", "op3_url_trust", "op7_suffix_dedup", "op9_chat"])
def test_oracles(spark, name):
    import duckdb

    from tidemark.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))
