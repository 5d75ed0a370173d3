import numpy as np

from tidemark.llm import op5_similar as ps
from tidemark.llm.op5_simhash import closest, fingerprint


def roots(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.root for r in ps.similar(docs).collect()}


def test_repeated_lines_do_not_hide_a_copy(spark):
    rows, times = [], [2, 6, 11, 21, 41]
    for g, k in enumerate(times):
        words, line = [f"g{g}w{i}" for i in range(400)], " ".join(f"g{g}line{i}" for i in range(8))
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words, *[line] * k]))]
    got = roots(spark, rows)
    assert all(got[2 * g] == got[2 * g + 1] for g in range(len(times)))
    assert len(set(got.values())) == len(times)


def test_a_common_run_joins_no_strangers(spark):
    run = "| " * 400
    rows = [(d, run + " ".join(f"d{d}w{i}" for i in range(300))) for d in range(6)]
    assert len(set(roots(spark, rows).values())) == len(rows)


def test_every_pair_at_the_bound_links(spark):
    rng, rows = np.random.default_rng(5), []
    for g in range(400):
        words = [f"g{g}w{i}" for i in range(229)]  # 225 shingles
        for at in 10 + 45 * np.arange(5) + rng.integers(0, 25, 5):  # 25 of them change: 200 of 250 shared
            words[at] = f"x{at}"
        rows += [(2 * g, " ".join(f"g{g}w{i}" for i in range(229))), (2 * g + 1, " ".join(words))]
    got = roots(spark, rows)
    assert sum(got[2 * g] != got[2 * g + 1] for g in range(400)) == 0
    assert len(set(got.values())) == 400


def test_simhash_links_copies_by_itself(spark, monkeypatch):
    rows = []
    for g in range(30):
        words = [f"g{g}w{i}" for i in range(600)]
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join([*words, f"end{g}"])), (3 * g + 2, " ".join(words[1:]))]
    rows += [(100, "| " * 400 + " ".join(f"a{i}" for i in range(300))), (101, "| " * 400 + " ".join(f"b{i}" for i in range(300)))]
    want = roots(spark, rows)  # with the exact join
    prints = {d: fingerprint(t) for d, t in rows}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= ps.REACH]
    assert (100, 101) in close and want[100] != want[101]  # close fingerprints alone join nothing
    assert len({p for p in close if p[1] < 90}) >= 60

    def none(batches):
        names = ["token", "node", "size", "pos", "root"]
        for _ in batches:
            yield ps.pa.RecordBatch.from_arrays([ps.pa.array([], t) for t in (ps.pa.int64(), ps.pa.int64(), ps.pa.int32(), ps.pa.int32(), ps.pa.int64())], names)

    monkeypatch.setattr(ps, "_tokens", none)
    got = roots(spark, rows)
    assert all(got[a] == got[b] for a, b in close if want[a] == want[b])
    assert got[100] != got[101] and len(set(got.values())) >= len(set(want.values())) == 32


def test_closest_is_a_least_spanning_forest():
    rng = np.random.default_rng(3)
    own = rng.integers(-(1 << 62), 1 << 62, 12)
    own = np.unique(own[rng.integers(0, 12, 300)] ^ (1 << rng.integers(0, 64, 300).astype("u8")).view("i8"))
    d = np.bitwise_count((own[:, None] ^ own[None, :]).view("u8"))
    i, j = np.nonzero(np.triu(d <= 3, 1))
    a, b = closest(own[i], own[j])
    assert set(zip(a.tolist(), b.tolist())) <= set(zip(own[i].tolist(), own[j].tolist()))
    root = {x: x for x in own.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    least = []
    for k in np.argsort(d[i, j], kind="stable"):
        x, y = find(own[i[k]].item()), find(own[j[k]].item())
        if x != y:
            root[x] = y
            least.append(int(d[i[k], j[k]]))
    assert sorted(np.bitwise_count((a ^ b).view("u8")).tolist()) == least
    assert closest(own[:0], own[:0])[0].size == 0
