import numpy as np
import pytest

from tidemark.llm import components as c


def brute(links):
    root = {x: x for e in links for x in e}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {n: low if r == high else r for n, r in root.items()}
    return {(n, r) for n, r in root.items() if n != r}


@pytest.mark.parametrize("most", [c.LINKS, 40])  # one task; several, and rounds between them
def test_components_of_any_number_of_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(c, "LINKS", most)
    rng = np.random.default_rng(4)
    links = [tuple(x) for x in rng.integers(-300, 300, (250, 2)).tolist()]
    links += [(1000, 1000 + i) for i in range(1, 60)]  # a hub
    links += [(2000 + i, 2001 + i) for i in range(80)]  # a chain
    links += links[:30] + [(b, a) for a, b in links[:30]] + [(5000, 5000)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {(r.a, r.b) for r in c.stars(edges).collect()} == brute(links)
    assert c.stars(edges.limit(0)).count() == 0


def test_links_are_slimmed_between_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(c, "LINKS", 20)
    links = [tuple(x) for x in np.random.default_rng(6).integers(0, 200, (400, 2)).tolist()]
    batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in links[k : k + 9]], "b": [b for _, b in links[k : k + 9]]}) for k in range(0, 400, 9)]
    got = [(a, b) for x in c._joined(batches) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)]
    assert set(got) == brute(links) and len(got) == len(set(got))
