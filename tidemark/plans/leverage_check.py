"""The leverage analysis as SQL for the check engine: the whole of it declared over relations.

It shares nothing with operators/leverage.py but the factor's text.
"""

from __future__ import annotations

from ..functions.mathx import clamp, normal_cdf, normal_ppf
from ..operators.sql_factors import RETURNS, ar1, check_sql, volume_ar_forecast

_PART = "PARTITION BY code ORDER BY ts_ms"


def relations(factor: str = RETURNS, value: str = "r", w: int = 250) -> str:
    """WITH ...: days, their scores, the profile, positions of all candidates and the best one of every code."""
    theta = ["0e0"]
    for _ in range(50):
        theta.append(f"{theta[-1]} + 5e-2")
    ppf = normal_ppf("u")
    rank = clamp("(len(list_filter(xs, lambda v: v <= x)) - 5e-1) / m", 0.000001, 0.999999).replace("1e-06e0", "1e-6")
    side = "CASE g.mode WHEN 'both' THEN abs(s.z) > g.theta WHEN 'pos' THEN s.z > g.theta ELSE s.z < -g.theta END"
    size = "1e0 + least(greatest((abs(s.z) - g.theta) / (greatest(p.cap, g.theta + 1e-3) - g.theta), 0e0), 1e0) * 1e0"
    return f"""WITH price AS (SELECT code, ts_ms, close, lead(close) OVER ({_PART}) AS ahead FROM {{bars}}),
factor AS (SELECT code, ts_ms, {value} AS x FROM ({factor}) WHERE {value} IS NOT NULL),
joined AS (SELECT p.code, p.ts_ms, ln(p.ahead / p.close) AS y, f.x FROM price p LEFT JOIN factor f ON p.code = f.code AND p.ts_ms = f.ts_ms WHERE p.close > 0 AND p.ahead > 0),
ranked AS (SELECT code, ts_ms, {rank} AS u FROM (
  SELECT code, ts_ms, x, list(x) OVER v AS xs, count(*) OVER v AS m FROM joined WHERE x IS NOT NULL WINDOW v AS ({_PART} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))),
counted AS (SELECT j.code, j.ts_ms, j.x, j.y, {ppf} AS z, row_number() OVER (PARTITION BY j.code ORDER BY j.ts_ms) AS i, count(*) OVER (PARTITION BY j.code) AS n, count(j.x) OVER (PARTITION BY j.code) AS finite
  FROM joined j LEFT JOIN ranked k ON j.code = k.code AND j.ts_ms = k.ts_ms),
parts AS (SELECT *, CAST(greatest(20, floor(6e-1 * n)) AS BIGINT) AS a, CAST(greatest(10, floor(2e-1 * n)) AS BIGINT) AS b FROM counted),
days AS (SELECT *, CASE WHEN i <= a THEN 'train' WHEN i <= a + b THEN 'val' ELSE 'test' END AS split, finite >= 30 AND n >= 60 AND n - a - b >= 10 AS ok FROM parts),
middle AS (SELECT code, median(x) AS mid FROM days WHERE split = 'train' AND ok AND x IS NOT NULL GROUP BY code),
cells AS (SELECT code, cell, count(*) AS c FROM (SELECT d.code, round((d.x - m.mid) / 1e-6) AS cell FROM days d JOIN middle m ON d.code = m.code WHERE d.split = 'train' AND d.x IS NOT NULL) GROUP BY code, cell),
freq AS (SELECT code, count(*) / sum(c) AS unique_ratio, max(c) / sum(c) AS max_freq_ratio FROM cells GROUP BY code),
tails AS (SELECT d.code, quantile_cont(d.x - m.mid, 9e-1) AS q9, quantile_cont(d.x - m.mid, 1e-1) AS q1, quantile_cont(d.x - m.mid, 5e-1) AS q5, least(greatest(quantile_cont(abs(d.z), 99e-2), 15e-1), 6e0) AS cap
  FROM days d JOIN middle m ON d.code = m.code WHERE d.split = 'train' AND d.x IS NOT NULL GROUP BY d.code),
shape AS (SELECT f.code, f.unique_ratio, f.max_freq_ratio, abs((t.q9 + t.q1) / 2 - t.q5) / greatest(1e-12, t.q9 - t.q1) AS symmetry_score, t.cap FROM freq f JOIN tails t ON f.code = t.code),
kinds AS (SELECT *, CASE WHEN unique_ratio < 15e-2 OR max_freq_ratio > 3e-2 THEN 'discrete' WHEN symmetry_score <= 2e-1 THEN 'symmetric' ELSE 'asymmetric' END AS kind FROM shape),
grid AS (SELECT t.k, t.theta, m.* FROM (SELECT generate_subscripts(l, 1) AS k, unnest(l) AS theta FROM (SELECT [{", ".join(theta)}] AS l)) t
  CROSS JOIN (VALUES ('symmetric', 1, 'both', 1e0), ('symmetric', 2, 'both', -1e0), ('asymmetric', 3, 'pos', 1e0), ('asymmetric', 4, 'pos', -1e0), ('asymmetric', 5, 'neg', 1e0), ('asymmetric', 6, 'neg', -1e0),
    ('discrete', 1, 'both', 1e0), ('discrete', 2, 'both', -1e0), ('discrete', 3, 'pos', 1e0), ('discrete', 4, 'pos', -1e0), ('discrete', 5, 'neg', 1e0), ('discrete', 6, 'neg', -1e0)) m(kind, o, mode, polarity)),
raw AS (SELECT s.code, s.i, s.a, s.b AS days_val, s.split, s.y, g.k, g.o, coalesce(CASE WHEN {side} THEN g.polarity * sign(s.z) * ({size}) END, 0e0) AS h
  FROM days s JOIN kinds p ON s.code = p.code JOIN grid g ON g.kind = p.kind WHERE s.ok AND s.split <> 'test'),
scale AS (SELECT code, k, o, sqrt(least(250, max(a)) / sum(h * h)) AS c FROM raw WHERE split = 'train' AND i > a - 250 GROUP BY code, k, o HAVING sum(h * h) > 1e-12),
curve AS (SELECT r.code, r.k, r.o, r.i, r.days_val, r.y, r.h, c.c, sum(c.c * r.h * r.y) OVER (PARTITION BY r.code, r.k, r.o ORDER BY r.i) AS e FROM raw r JOIN scale c ON r.code = c.code AND r.k = c.k AND r.o = c.o WHERE r.split = 'val'),
below AS (SELECT *, greatest(max(e) OVER (PARTITION BY code, k, o ORDER BY i), 0e0) - e AS dd FROM curve),
valued AS (SELECT code, k, o, max(c) AS c, CAST(max(days_val) AS DOUBLE) AS t, sum(c * c * h * h) AS ll, sum(c * h * y) AS lr, sum(dd * dd) AS dd2, count(CASE WHEN h <> 0 THEN 1 END) AS trades FROM below GROUP BY code, k, o),
won AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(score, 10) DESC, k, o) AS place FROM (
  SELECT code, k, o, c, sqrt(t / ll) * (252e0 / t * lr) / sqrt(252e0 / t * dd2) AS score FROM valued WHERE trades >= ceil(t / 252e0 * 50e0 - 1e-12) AND ll > 1e-12 AND sqrt(dd2 / t) > 1e-12)),
best AS (SELECT w.code, q.kind, q.unique_ratio, q.max_freq_ratio, q.symmetry_score, g.mode, g.polarity, g.theta, greatest(q.cap, g.theta + 1e-3) AS z_cap, w.c, w.score
  FROM won w JOIN kinds q ON w.code = q.code JOIN grid g ON g.k = w.k AND g.o = w.o AND g.kind = q.kind WHERE w.place = 1),
levels AS (SELECT b.code, quantile_disc_low AS low, quantile_disc_high AS high FROM best b JOIN (
  SELECT code, sum(CASE WHEN j = floor(pl * (m - 1)) THEN x * (1 - (pl * (m - 1) - floor(pl * (m - 1)))) WHEN j = floor(pl * (m - 1)) + 1 THEN x * (pl * (m - 1) - floor(pl * (m - 1))) ELSE 0e0 END) AS quantile_disc_low,
         sum(CASE WHEN j = floor(ph * (m - 1)) THEN x * (1 - (ph * (m - 1) - floor(ph * (m - 1)))) WHEN j = floor(ph * (m - 1)) + 1 THEN x * (ph * (m - 1) - floor(ph * (m - 1))) ELSE 0e0 END) AS quantile_disc_high
  FROM (SELECT d.code, d.x, row_number() OVER (PARTITION BY d.code ORDER BY d.x) - 1 AS j, count(*) OVER (PARTITION BY d.code) AS m, {normal_cdf("b.theta")} AS ph, 1 - {normal_cdf("b.theta")} AS pl
        FROM days d JOIN best b ON d.code = b.code WHERE d.split = 'train' AND d.x IS NOT NULL) GROUP BY code) q ON b.code = q.code),
policy AS (SELECT b.*, CASE WHEN b.mode <> 'pos' THEN l.low END AS raw_low, CASE WHEN b.mode <> 'neg' THEN l.high END AS raw_high FROM best b JOIN levels l ON b.code = l.code),
taken AS (SELECT s.code, s.ts_ms, s.i, s.split, s.x, s.z, s.y, g.kind, g.unique_ratio, g.max_freq_ratio, g.symmetry_score, g.mode, g.polarity, g.theta, g.z_cap, g.c, g.raw_low, g.raw_high,
  coalesce(CASE WHEN {side} THEN g.polarity * sign(s.z) * ({size.replace("greatest(p.cap, g.theta + 1e-3)", "g.z_cap")}) END, 0e0) AS h FROM days s JOIN policy g ON s.code = g.code),
path AS (SELECT *, greatest(max(e) OVER (PARTITION BY code ORDER BY i), 0e0) - e AS dd FROM (SELECT *, sum(c * h * y) OVER (PARTITION BY code ORDER BY i) AS e FROM taken))"""


def _ask(select: str, factor: str = RETURNS, value: str = "r") -> str:
    return check_sql(f"{relations(factor, value)}\n{select}")


_SEARCH = "SELECT code, mode, polarity, round(theta, 6) AS theta, round(c, 6) AS c_scale, round(score, 6) AS score FROM best"
_SEG = "PARTITION BY code, split ORDER BY i"
_RATIO = "sqrt(n / {ll}) * (252e0 / n * {lr}) / sqrt(252e0 / n * {dd})"
ORACLES = {
    "leverage_eligible": _ask("SELECT code, max(n) AS n, max(finite) AS n_finite, max(a) AS n_train, max(b) AS n_val, max(n - a - b) AS n_test, CAST(max(CASE WHEN ok THEN 1 ELSE 0 END) AS INT) AS eligible FROM days GROUP BY code"),
    "leverage_profile": _ask("SELECT code, kind AS profile_kind, round(unique_ratio, 6) AS unique_ratio, round(max_freq_ratio, 6) AS max_freq_ratio, round(symmetry_score, 6) AS symmetry_score, round(z_cap, 6) AS z_cap FROM best"),
    "leverage_search": _ask(_SEARCH),
    "leverage_ar1_return": _ask(_SEARCH, ar1(), "ar1_return_coeff"),
    "leverage_volume_ar_forecast": _ask(_SEARCH, volume_ar_forecast(), "vol_ar1_pred_ratio"),
    "leverage_thresholds": _ask("SELECT code, mode, round(theta, 6) AS theta, round(raw_low, 6) AS raw_threshold_low, round(raw_high, 6) AS raw_threshold_high FROM policy"),
    "leverage_path": _ask("""SELECT code, ts_ms, split, round(x, 5) AS factor_raw, round(z, 5) AS z, kind AS profile_kind, round(symmetry_score, 5) AS symmetry_score, round(unique_ratio, 5) AS unique_ratio, round(max_freq_ratio, 5) AS max_freq_ratio,
  mode, polarity, round(theta, 5) AS theta, round(z_cap, 5) AS z_cap, round(c, 5) AS c_scale, round(h, 5) AS b_raw, round(c * h, 5) AS leverage, round(y, 5) AS next_return, round(e, 5) AS equity, round(dd, 5) AS drawdown,
  CAST(CASE WHEN h <> 0 THEN 1 ELSE 0 END AS INT) AS active, round(raw_low, 5) AS raw_threshold_low, round(raw_high, 5) AS raw_threshold_high FROM path"""),
    "leverage_segments": _ask("SELECT code, split, count(*) AS n, round(sum(c * h * y), 4) AS gain, round(sum(y), 4) AS hold, round(max(dd), 4) AS worst FROM path GROUP BY code, split"),
    "leverage_report": _ask(f"""SELECT code, split, CAST(n AS BIGINT) AS n, first_ms, last_ms, CASE WHEN good THEN round({_RATIO.format(ll="ll", lr="lr", dd="dd2")}, 4) END AS score,
  CASE WHEN good AND hd > 1e-12 THEN round({_RATIO.format(ll="n", lr="hr", dd="hd")}, 4) END AS baseline_score, CASE WHEN good THEN round(lr, 4) END AS final_equity, CASE WHEN good THEN round(sqrt(dd2 / n), 4) END AS dd_rms, CAST(CASE WHEN good THEN trades ELSE 0 END AS BIGINT) AS trade_days FROM (
  SELECT *, ll > 1e-12 AND dd2 > 1e-12 AS good FROM (
    SELECT code, split, CAST(count(*) AS DOUBLE) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, sum(l * l) AS ll, sum(l * y) AS lr, sum(y) AS hr, sum(d * d) AS dd2, sum(g * g) AS hd, count(CASE WHEN h <> 0 THEN 1 END) AS trades FROM (
      SELECT *, greatest(max(own) OVER ({_SEG}), 0e0) - own AS d, greatest(max(held) OVER ({_SEG}), 0e0) - held AS g FROM (
        SELECT *, c * h AS l, sum(c * h * y) OVER ({_SEG}) AS own, sum(y) OVER ({_SEG}) AS held FROM path)) GROUP BY code, split))"""),
}
