"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import op1_bpe_chunks, op2_embeddings, op3_url_trust, op4_packing, op5_simhash, op6_quality, op7_suffix_dedup, op8_pii, op9_chat, op10_token_counts

QUERIES = {
    "op1_bpe_chunks": op1_bpe_chunks.query,
    "op2_embeddings": op2_embeddings.query,
    "op3_url_trust": op3_url_trust.query,
    "op4_packing": op4_packing.query,
    "op5_simhash": op5_simhash.query,
    "op6_quality": op6_quality.query,
    "op7_suffix_dedup": op7_suffix_dedup.query,
    "op8_pii": op8_pii.query,
    "op9_chat": op9_chat.query,
    "op10_token_counts": op10_token_counts.query,
}


def _op2() -> str:
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
d AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT v.vec_id, CAST(coalesce(d.k, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.x LEFT JOIN d ON v.vec_id = d.x"""


def _op3() -> str:
    """The walks unrolled: one table expression a round."""
    damping, rounds = op3_url_trust.DAMPING, op3_url_trust.ROUNDS
    ordered = sorted(op3_url_trust.RULES, key=lambda r: -len(r[1] + r[2]))

    def case(k):
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(t, v)[k]}'" for t, h, p, v in ordered) + " END"

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    url = r"'^(?s:.*?)://([^/?#]*)([^?#]*)'"
    sql = f"""
WITH u AS (
  SELECT page_id, html, {lower.format(f"regexp_extract(coalesce(url, ''), {url}, 1)")} AS host, regexp_extract(coalesce(url, ''), {url}, 2) AS path FROM pages),
p AS (SELECT page_id, host, path, html, {case(0)} AS rule, {case(1)} AS said FROM u),
s AS (
  SELECT host, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad
  FROM p WHERE said IS NOT NULL AND host <> '' GROUP BY host),
t AS (SELECT greatest(sum(good), 1) AS good, greatest(sum(bad), 1) AS bad FROM s),
f AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?[a-z][a-z0-9+.-]*://([^/?#"''\\s>]+)', 1))) AS dst FROM p WHERE host <> ''),
k AS (SELECT src, {lower.format("dst")} AS dst, count(*) AS n FROM f WHERE src <> {lower.format("dst")} GROUP BY 1, 2),
e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM k),
b AS (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS w FROM e),
g0 AS (SELECT host, good / (SELECT good FROM t) * {1 - damping} AS v FROM s WHERE good > 0),
h0 AS (SELECT host, bad / (SELECT bad FROM t) * {1 - damping} AS v FROM s WHERE bad > 0)"""
    for name, edges in (("g", "e"), ("h", "b")):
        for i in range(rounds):
            sql += f""",
{name}{i + 1} AS (SELECT host, sum(v) AS v FROM (SELECT host, v FROM {name}0 UNION ALL SELECT x.dst, x.w * y.v * {damping} FROM {edges} x JOIN {name}{i} y ON x.src = y.host) GROUP BY host)"""
    return (
        sql
        + f"""
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.said, CASE WHEN coalesce(h.v, 0) > 0 AND h.v >= coalesce(g.v, 0) * {op3_url_trust.OUTWEIGH} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN g{rounds} g ON p.host = g.host LEFT JOIN h{rounds} h ON p.host = h.host"""
    )


def _op7() -> str:
    return """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 49, 0))) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM w),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM m WHERE low < doc_id),
o AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM o GROUP BY doc_id, k),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r),
t AS (
  SELECT d.doc_id, sum(q.z - q.a) AS gone, count(q.a) AS spans, max(q.z) AS z,
         string_agg(substring(d.x, 2 * q.p + 1, 2 * (q.a - q.p)), '' ORDER BY q.a) AS x
  FROM d JOIN q ON d.doc_id = q.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(t.x, '') || substring(d.x, 2 * coalesce(t.z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""


def _op9() -> str:
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{op9_chat.PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{op9_chat.PROBE}'),
s AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learnt,
         sum(length(text) + 2 * length(CASE WHEN role = 'user' THEN 'INST' ELSE role END) + 12
             + length(regexp_replace(text, '[^<\\[\\\\]', '', 'g'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM s"""


ORACLES = {"op2_embeddings": _op2(), "op3_url_trust": _op3(), "op7_suffix_dedup": _op7(), "op9_chat": _op9()}
