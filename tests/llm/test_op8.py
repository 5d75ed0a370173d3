import hashlib
import random
import re

from tidemark.llm import op8_pii as p8

PY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        if not 12 <= len(digits) <= 19:
            return False
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (2 if i % 2 else 1)
            total += d - 9 * (d > 9)
        return total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(PY.items()) for m in re.finditer(p, text or "") if ok(kind, m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


ODD = [
    None, "", "a@b.c@d.e", "a@b.c_d@e.f x..@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 000255.01.1.1", "é😀 4242 4242-4242 4242, +1 (212) 555-0100.",
    "9" * 30_000, "a" * 60_000 + "@x.y", "a@" + "b." * 30_000 + "c", "1 " * 30_000, "+1" + "-2" * 9_000, "4539578763621486 " * 3, "x@y 1-2 +12 3", ".@a.b", "a@b..c",
]


def test_base_spans(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("a1.@ +-(4)é\n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id or 0: [f"{s.kind}:{s.start}:{s.end}" for s in r.base] for r in p8.find(docs, "doc_id").collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), (i, t and t[:100])


def test_query(spark):
    src = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = p8.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(src)
    for r in rows:
        want = plain(src[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_contexts_discover(spark):
    rng = random.Random(1)
    rows = [(i, f"text caller phone: +1 212 555 {1000 + i} reached w{rng.random()}"[:-12] + " end") for i in range(40)]
    rows += [(100, "caller phone: 212-555-0199x reached"), (101, "build number 20190401 done"), (102, "build 99x99yz stays")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in p8.extract(docs).collect()}
    assert got[100] == [("phone", 14, 27)]
    assert got[101] == got[102] == []
    clean = {r.doc_id: r.text for r in p8.redact(docs).collect()}
    assert clean[100] == "caller phone: [PHONE] reached" and clean[102] == rows[-1][1]
    assert clean[3].startswith("text caller phone: [PHONE] reached")


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a@b.c 4242424242424242"), (1, "a@b.c 4242424242424242"), (None, None), (1, None)], "doc_id long, text string")
    got = p8.redact(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (1, ""), (1, "[EMAIL] [CARD]"), (1, "[EMAIL] [CARD]")]
    assert p8.extract(docs.limit(0)).count() == 0
