import math

import numpy as np
import pytest

from tidemark.llm import op2_embeddings as p2


def brute(rows):
    ok = [l is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, l in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    x = [np.array(v, float) if o else None for (_, v, _), o in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and x[i].size == x[j].size and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 1 << 60), r[0] if r[0] is not None else 1 << 60)
    return sorted((r[0] if r[0] is not None else -1, links[i], low[find(i)] if low[find(i)] < 1 << 60 else -1) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [4096, 37])
def test_links_and_components(spark, monkeypatch, tile):
    monkeypatch.setattr(p2, "TILE", tile)
    rng = np.random.default_rng(0)
    src = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    hot = rng.standard_normal(64)
    rows = src + [(1000 + i, (hot + rng.standard_normal(64) * s).tolist(), 3) for i, s in enumerate(np.linspace(0.05, 0.5, 200))]
    rows += [(2000 + i, (np.array(v) * 3).tolist(), l) for i, (_, v, l) in enumerate(src[:50])]
    rows += [(3000, None, 1), (3001, [0.0] * 64, 1), (3002, [1.0, None], 1), (3003, [float("nan"), 1.0], 1), (3004, [1.0, 0.0], None), (3005, [1.0, 0.1], 1), (3006, [1.0, 0.11], 1), (3006, [1.0, 0.11], 1), (None, [1.0, 0.1], 1), (3007, [], 1), (None, [-1.0, 0.5], 1)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in p2.near_duplicates(vectors).collect())
    assert got == brute(rows)
    assert p2.near_duplicates(vectors.limit(0)).count() == 0
