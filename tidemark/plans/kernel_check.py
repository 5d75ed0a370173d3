"""SQL of the kernel factors that SQL can express, written apart from the kernels: recursions a bar at a time, filters
as nested lags, spectra as explicit sums."""

from __future__ import annotations

import math

from ..operators.event_factors import PRICES
from ..operators.kernels import DB4
from ..operators.sql_factors import RETURNS, check_sql

_PART = "PARTITION BY code ORDER BY ts_ms"
_NUMBERED = f"(SELECT code, ts_ms, r, row_number() OVER ({_PART}) AS i FROM {RETURNS} WHERE r IS NOT NULL)"


def _rows(select: str) -> str:
    return check_sql(f"SELECT code, ts_ms, topic, round(value, 6) AS value FROM ({select})")


def _hmm(cap: str = "r") -> str:
    """WITH RECURSIVE p(code, i, up): filtered probabilities by Bayes' rule from densities."""
    power = lambda mu, sd: f"(-5e-1 * ((x - ({mu}e0)) / {sd}e0) * ((x - ({mu}e0)) / {sd}e0))"
    a, b = power(0.006, 0.010), power(-0.006, 0.012)
    a, b = (f"exp({x} - greatest({a}, {b})) / {sd}e0" for x, sd in ((a, 0.010), (b, 0.012)))  # far returns: the ratio alone
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT code, ts_ms, {cap} AS x, i FROM {_NUMBERED}),
d AS MATERIALIZED (SELECT code, ts_ms, i, {a} AS f, {b} AS g FROM b),
p(code, i, up) AS (SELECT code, i, 5e-1 * f / (5e-1 * f + 5e-1 * g) FROM d WHERE i = 1
  UNION ALL SELECT d.code, d.i, (p.up * 9e-1 + (1 - p.up) * 1e-1) * f / ((p.up * 9e-1 + (1 - p.up) * 1e-1) * f + (p.up * 1e-1 + (1 - p.up) * 9e-1) * g) FROM p JOIN d ON d.code = p.code AND d.i = p.i + 1)"""


def _hmm2() -> str:
    odds = "least(greatest(p.up, 1e-12), 1 - 1e-12)"
    return check_sql(f"""{_hmm("least(greatest(r, -2e-1), 2e-1)")}
SELECT d.code, d.ts_ms, 'kline/hmm2_logodds' AS topic, round(ln({odds} / (1 - {odds})), 6) AS value FROM p JOIN d ON p.code = d.code AND p.i = d.i WHERE d.i >= 60""")


def _uptrend() -> str:
    return check_sql(f"""{_hmm()}
SELECT d.code, d.ts_ms, t.topic, round(CASE WHEN t.topic = 'kline_new/hmm_uptrend_prob' THEN p.up ELSE 6e-3 * (p.up * 8e-1 + 1e-1) - 6e-3 * (9e-1 - p.up * 8e-1) END, 6) AS value
FROM p JOIN d ON p.code = d.code AND p.i = d.i CROSS JOIN (VALUES ('kline_new/hmm_uptrend_prob'), ('kline_new/hmm_next_drift')) t(topic) WHERE d.i >= 40""")


def _kalman(w: int = 60, k: int = 5) -> str:
    """The filter's state a bar at a time: level, slope and covariance; then k steps of the forecast, one by one."""
    far = "SELECT code, i, ts_ms, y, m, l, s, a, b, c FROM f WHERE i >= " + str(w)
    for _ in range(k):
        far = f"SELECT code, i, ts_ms, y, m, l + s AS l, s, a + 2 * b + c AS a, b + c AS b, c + 1e-2 * m AS c FROM ({far})"
    step = lambda l, s, a, b, c: f"SELECT n.code, n.i, n.ts_ms, n.y, n.m, {l} + {s} AS l0, {s} AS s0, {a} + 2 * {b} + {c} AS a0, {b} + {c} AS b0, {c} + 1e-2 * n.m AS c0"
    gained = "SELECT code, i, ts_ms, y, m, l0, s0, a0, b0, c0, a0 / (a0 + 1e-1 * m) AS g, b0 / (a0 + 1e-1 * m) AS h FROM ({})"
    done = lambda x: f"SELECT code, i, ts_ms, y, m, l0 + g * (y - l0), s0 + h * (y - l0), (1 - g) * (1 - g) * a0 + g * g * 1e-1 * m, (1 - g) * b0 - h * (1 - g) * a0 + g * h * 1e-1 * m, c0 - 2 * h * b0 + h * h * (a0 + 1e-1 * m) FROM ({gained.format(x)})"
    return check_sql(f"""WITH RECURSIVE n AS MATERIALIZED (
  SELECT code, ts_ms, ln(close) AS y, row_number() OVER ({_PART}) AS i, avg(CASE WHEN high > 0 AND low > 0 THEN ln(high / low) * ln(high / low) / (4 * ln(2e0)) ELSE 0e0 END) OVER ({_PART} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS m FROM {{tick_bars}} WHERE close > 0),
f(code, i, ts_ms, y, m, l, s, a, b, c) AS ({done(step("n.y", "0e0", "1e0", "0e0", "1e0") + " FROM n WHERE n.i = 1")}
  UNION ALL {done(step("f.l", "f.s", "f.a", "f.b", "f.c") + " FROM f JOIN n ON n.code = f.code AND n.i = f.i + 1")})
SELECT code, ts_ms, 'kline/kalman_forecast_z' AS topic, round(least(greatest((l - y) / sqrt(a + 1e-1 * m), -50e0), 50e0), 6) AS value FROM ({far})""")


def _zero_cross(w: int = 40) -> str:
    """Signs of the deviations from the mean as a list; zeros out, neighbours compared."""
    return _rows(f"""SELECT code, ts_ms, 'kline/ma_zero_cross_rate' AS topic, len(list_filter(range(2, len(s) + 1), lambda j: s[j] <> s[j - 1])) / {w - 1}e0 AS value FROM (
  SELECT code, ts_ms, list_filter(list_transform(xs, lambda v: sign(v - m)), lambda v: v <> 0) AS s FROM (
    SELECT code, ts_ms, list(close) OVER v AS xs, avg(close) OVER v AS m, count(*) OVER v AS n FROM {{bars}} WHERE close > 0 WINDOW v AS ({_PART} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)) WHERE n = {w})""")


def _low_freq(n: int = 64, k: int = 3, m: int = 10) -> str:
    """Three bins summed explicitly; all bins together by Parseval's identity."""
    part = lambda f, j: f"list_sum(list_transform(xs, lambda v, t: v * {f}({2 * math.pi * j / n!r}e0 * t)))"
    low = " + ".join(f"pow({part('cos', j)}, 2) + pow({part('sin', j)}, 2)" for j in range(1, k + 1))
    return _rows(f"""SELECT code, ts_ms, 'kline/ret_lowfreq_mu10' AS topic, ({low}) / (({n} * list_sum(list_transform(xs, lambda v: (v - mu) * (v - mu))) + pow({part('cos', n // 2)}, 2)) / 2) * late AS value FROM (
  SELECT code, ts_ms, list(r) OVER v AS xs, avg(r) OVER v AS mu, avg(r) OVER ({_PART} ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) AS late, i FROM {_NUMBERED} WINDOW v AS ({_PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE i >= {n}""")


def _haar(w: int = 32, levels: int = 2) -> str:
    """Block sums of centred log closes over the root of the block's size."""
    size = 2**levels
    blocks = f"list_transform(range(0, {w // size}), lambda b: list_sum(list_transform(xs[b * {size} + 1 : b * {size} + {size}], lambda v: v - mu)) / {math.sqrt(size)!r}e0)"
    return _rows(f"""SELECT code, ts_ms, 'kline_new/haar_trend_energy' AS topic, coalesce(list_sum(list_transform({blocks}, lambda v: v * v)) / nullif(list_sum(list_transform(xs, lambda v: (v - mu) * (v - mu))), 0), 0) * sign(xs[{w}] - xs[1]) AS value FROM (
  SELECT code, ts_ms, list(ln(close)) OVER v AS xs, avg(ln(close)) OVER v AS mu, count(*) OVER v AS n FROM {{bars}} WHERE close > 0 WINDOW v AS ({_PART} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)) WHERE n = {w}""")


def _wavelet(source: str = "(SELECT code, ts_ms, close FROM {bars} WHERE close > 0)", w: int = 128, levels: int = 6, first: int = 4, ts: str = "ts_ms") -> str:
    """The pyramid as nested lags: each level filters the smooth of the one before with the taps spread out."""
    root = math.sqrt(2)
    part = f"PARTITION BY code ORDER BY {ts}"
    now = f"SELECT code, {ts}, ln(close) AS p, ln(close / lag(close) OVER ({part})) AS s FROM {source}"
    now = f"SELECT * FROM ({now}) WHERE s IS NOT NULL"
    for j in range(levels):
        at = [f"coalesce(lag(s, {i * 2**j}) OVER ({part}), 0)" if i else "s" for i in range(8)]
        smooth = " + ".join(f"({DB4[i] / root!r}) * {at[i]}" for i in range(8)).replace("np.float64", "")
        detail = " + ".join(f"({(-1) ** i * DB4[7 - i] / root!r}) * {at[i]}" for i in range(8)).replace("np.float64", "")
        now = f"SELECT * EXCLUDE (s), {smooth} AS s, {detail} AS d{j + 1} FROM ({now})"
    frame = f"({part} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    total = [f"sum(d{j} * d{j}) OVER v" for j in range(1, levels + 1)]
    return check_sql(f"""SELECT code, {ts}, 'wave_trend/energy_ratio' AS topic, round(coalesce(last_value(CASE WHEN abs(move) > 1e-12 THEN sign(move) END IGNORE NULLS) OVER ({part}), 1) * share, 6) AS value FROM (
  SELECT code, {ts}, p - before AS move, coarse / every AS share FROM (
    SELECT code, {ts}, p, start AS before, {" + ".join(total[first - 1 :])} AS coarse, {" + ".join(total)} AS every, count(*) OVER v AS n FROM (
      SELECT q.*, o.start FROM ({now}) q JOIN (SELECT code, {ts}, lag(ln(close), {w}) OVER ({part}) AS start FROM {source}) o ON q.code = o.code AND q.{ts} = o.{ts}) WINDOW v AS {frame}) WHERE n = {w})""")


ORACLES = {
    "hmm2_logodds": _hmm2(), "hmm_uptrend": _uptrend(), "kalman_forecast_z": _kalman(), "ma_zero_cross": _zero_cross(), "low_freq_return": _low_freq(), "haar_wavelet_trend": _haar(),
    "wavelet_trend_energy": _wavelet(), "event_wavelet_energy": _wavelet(f"({PRICES})", ts="arrival"),
}
