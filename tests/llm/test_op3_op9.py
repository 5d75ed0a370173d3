import hashlib

from pyspark.sql import functions as F

from tidemark.llm import op3_url_trust as p3
from tidemark.llm import op9_chat as p9


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in p3.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fits, key=lambda r: len(r[1] + r[2])) if fits else None


def test_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = [(None, None, None), (1, "no scheme", "x"), (1, "no scheme", "x"), (2, "HTTP://Ex.ORG", None), (3, "a://b://example.org/es/x", ""), (4, "x://example.org?q=/es/", ""), (5, "x://É.COM/fr/1#://y", "")]
    extra = spark.createDataFrame([(*r, "clash") for r in odd], "page_id long, url string, html string, host string")
    both = pages.withColumn("host", F.lit("h")).unionByName(extra)
    got = sorted(((r.page_id or -1, r.host, r.path, r.rule, r.verdict) for r in p3.judge(both).collect()), key=str)
    src = [(r.page_id or -1, plain_rule(r.url)) for r in both.collect()]
    assert sorted([g[:4] for g in got], key=str) == sorted([(i, h, p, r and r[0]) for i, (h, p, r) in src], key=str)
    for _, _, _, rule, verdict in got:
        assert rule is None or verdict == {r[0]: r[3] for r in p3.RULES}[rule]
    assert p3.judge(both.limit(0)).count() == 0


def test_trust_and_distrust_spread(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/p">x</a>' for x in h)
    pages = spark.createDataFrame(
        [
            (1, "http://good.org/a", link("friend.net")),
            (2, "http://bad.com/de/1", link("other.net")),
            (3, "http://farm.net/1", link("bad.com", "bad.com")),
            (4, "http://friend.net/1", ""),
            (5, "http://far.net/1", link("farm.net")),
            (6, "http://alone.net/1", None),
        ],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r for r in p3.judge(pages).collect()}
    assert got[3].verdict == "block" and got[5].verdict == "block"
    assert got[4].verdict == "allow" and got[4].trust > 0 and got[6].verdict == "allow"
    # against a plain power iteration
    edges = {("good.org", "friend.net"), ("bad.com", "other.net"), ("farm.net", "bad.com"), ("far.net", "farm.net")}
    score = {}
    for _ in range(60):
        new = {}
        for s, d in edges:
            new[s] = new.get(s, 0) + 0.85 * score.get(d, 0)
        new["bad.com"] = new.get("bad.com", 0) + 0.15
        score = new
    for i, h in ((3, "farm.net"), (5, "far.net"), (2, "bad.com")):
        assert abs(got[i].distrust - score[h]) < 1e-5


TEXTS = ["</s>[INST] ok [/INST]", "\\", "<\\", "[\\<", "\\\\[", "", "a]b[/x]</s>", None, "é😀<s>"]


def test_chat_round_trip(spark):
    rows = [(c, i, ["user", "assistant", "system", None, "INST", "od]d/%5D<["][(c + i) % 6], t, "x") for c in range(6) for i, t in enumerate(TEXTS)]
    rows += [(None, 1, "user", "hi", "x"), (9, None, "assistant", "b", "x"), (9, None, "assistant", "b", "x"), (9, 0, "assistant", "a", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = p9.format_chat(turns.withColumn("parts", p9.text_part(F.col("text"))))
    got = {r.conv_id: r for r in done.withColumn("turns", p9.read_back(F.col("formatted"))).withColumn("learnt", p9.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    convs = {}
    for c, i, role, text, _ in rows:
        convs.setdefault(c, []).append((i if i is not None else -1, role or "", text or ""))
    for c, own in convs.items():
        own = sorted(own)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in own]
        assert got[c].learnt == "".join(t for _, r, t in own if r == "assistant")
        for s in got[c].loss:
            assert "</s>" not in got[c].formatted[s.start : s.start + s.length]
    empty = p9.format_chat(turns.limit(0).withColumn("parts", p9.text_part(F.col("text"))))
    assert empty.columns == done.columns and empty.collect() == []


def test_long_conversation_positions(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"text {i} <") for i in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = p9.format_chat(turns.withColumn("parts", p9.text_part(F.col("text")))).withColumn("learnt", p9.loss_text(F.col("formatted"), F.col("loss"))).first()
    assert r.learnt == "".join(t for _, _, role, t in rows if role == "assistant")


def test_attachments(spark):
    parts = [("text", "look <image>: ", None, None, None, None, None), ("image", None, "s://i", 56, 29, None, None), ("audio", None, "s://a", None, None, 1.5, None), ("document", None, "s://d", None, None, None, 3), (None, "end", None, None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{p9.PART}>")
    r = p9.format_chat(turns).first()
    assert r.formatted == "<s>[INST]look <\\image>: <image><audio><document>end[/INST]</s><s>[assistant][/assistant]</s>"
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "s://i", 4), (0, 1, "audio", "s://a", 38), (0, 2, "document", "s://d", 3072)]
    assert r.expanded_tokens == 4 + 38 + 3072


def test_query(spark):
    src = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        src.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    src[-7] = [(0, "user", p9.PROBE), (1, "assistant", p9.PROBE)]
    got = p9.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(src)
    for r in got:
        own = sorted(src[r.conv_id])
        learnt = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
