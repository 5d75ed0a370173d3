from tidemark.llm import op3_url_trust as p3


def test_walk_settles_and_reaches_all(spark):
    chain = [(f"c{i}", f"c{i + 1}", 1.0) for i in range(24)]
    edges = spark.createDataFrame([*chain, ("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("c0", 0.5), ("a", 0.5)], "host string, seed double")
    got = {r.host: r.score for r in p3.walk(edges, seeds).collect()}
    want, base = {}, {"c0": 0.075, "a": 0.075}
    for _ in range(400):
        new = dict(base)
        for s, d, w in [*chain, ("a", "b", 1.0), ("b", "a", 1.0)]:
            if s in want:
                new[d] = new.get(d, 0.0) + 0.85 * w * want[s]
        want = new
    assert set(got) == set(want)
    assert all(abs(got[h] - want[h]) < 1e-5 * want[h] for h in want)


def test_protocol_relative_links_are_edges(spark):
    html = """<a href='//Host.example/x'>a</a> <a href="http://two.example">b</a> <a href="/p//q">c</a> <a href=//three.example?x>d</a> <a href="x//y">e</a>"""
    pages = spark.createDataFrame([(1, "http://one.example/", html), (2, "http://four.example/", "<a href='//one.example'>")], "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in p3.host_edges(pages).collect()}
    assert got == {("one.example", "host.example"), ("one.example", "two.example"), ("one.example", "three.example"), ("four.example", "one.example")}
