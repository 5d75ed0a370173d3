"""Window factors as SQL over the market views.

One text serves Spark and the check engine: {bars} and the other views are put in by name, and the few
words that differ between dialects are tokens of DIALECTS.  Within a code a factor sees a trailing
frame of rows in order of time, and gives a row from the first full frame on.  Rows that a factor
ignores are filtered before any lag.  Every text has one sort by code, shared by all its frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.calendar import in_session
from ..functions.mathx import clamp, normal_cdf, normal_ppf, parkinson
from ..sources.views import SQL, VIEWS

DIALECTS = {
    "spark": {"div": "div", "list": "collect_list", "count_le": "size(filter({xs}, y -> y <= {x}))", "quantile": "percentile({x}, {q})"},
    "check": {"div": "//", "list": "list", "count_le": "len(list_filter({xs}, lambda y: y <= {x}))", "quantile": "quantile_cont({x}, {q})"},
}


def rows(n: int, name: str = "w", order: str = "ts_ms") -> str:
    return f"{name} AS (PARTITION BY code ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


#: Log returns of bars with a positive close.
RETURNS = "(SELECT *, ln(close / lag(close) OVER (PARTITION BY code ORDER BY ts_ms)) AS r FROM {bars} WHERE close > 0)"
TICK_RETURNS = RETURNS.replace("{bars}", "{tick_bars}")


def safe_corr(y: str, x: str, frame: str = "w") -> str:
    """Correlation over a frame; null where a side does not vary."""
    return f"regr_sxy({y}, {x}) OVER {frame} / sqrt(nullif(regr_sxx({y}, {x}) OVER {frame} * regr_syy({y}, {x}) OVER {frame}, 0e0))"


def ret_logvol_corr(w: int = 40) -> str:
    src = RETURNS.replace("close > 0", "close > 0 AND volume > 0")
    return f"""SELECT code, ts_ms, round(c, 6) AS ret_logvol_corr FROM (
  SELECT code, ts_ms, {safe_corr('r', 'ln(volume)')} AS c, count(r) OVER w AS n FROM {src} WHERE r IS NOT NULL WINDOW {rows(w)}) WHERE n = {w} AND c IS NOT NULL"""


def ar1(w: int = 40) -> str:
    return f"""SELECT code, ts_ms, round(phi, 6) AS ar1_return_coeff FROM (
  SELECT code, ts_ms, regr_slope(r, p) OVER w AS phi, count(p) OVER w AS n FROM (
    SELECT code, ts_ms, r, lag(r) OVER (PARTITION BY code ORDER BY ts_ms) AS p FROM {RETURNS} WHERE r IS NOT NULL) WINDOW {rows(w - 1)}) WHERE n = {w - 1} AND phi IS NOT NULL"""


def _weighted(r_cap: float, floor: float) -> str:
    return f"""(SELECT code, ts_ms, {clamp("r", -r_cap, r_cap)} AS r, 1e0 / greatest({parkinson()}, {floor!r}) AS g FROM {TICK_RETURNS} WHERE r IS NOT NULL AND high > 0 AND low > 0)"""


def wls_drift_z(w: int = 60, least: int = 20, r_cap: float = 0.2, floor: float = 1e-8) -> str:
    return f"""SELECT code, ts_ms, round({clamp("a / sqrt(b)", -50, 50)}, 6) AS wls_drift_z FROM (
  SELECT code, ts_ms, sum(g * r) OVER w AS a, sum(g) OVER w AS b, count(*) OVER w AS n FROM {_weighted(r_cap, floor)} WINDOW {rows(w)}) WHERE n >= {least}"""


def bayes_drift_logodds(w: int = 60, least: int = 20, r_cap: float = 0.2, floor: float = 1e-8, mu0: float = 0.0, tau0: float = 0.01) -> str:
    prior = 1 / tau0**2
    p = clamp(normal_cdf("t"), 1e-12, 1 - 1e-12).replace("1e-12e0", "1e-12")
    return f"""SELECT code, ts_ms, round({clamp("ln(p / (1e0 - p))", -50, 50)}, 6) AS bayes_drift_logodds FROM (
  SELECT code, ts_ms, {p} AS p FROM (
    SELECT code, ts_ms, ({mu0 * prior!r}e0 + a) / ({prior!r}e0 + b) * sqrt({prior!r}e0 + b) AS t FROM (
      SELECT code, ts_ms, sum(g * r) OVER w AS a, sum(g) OVER w AS b, count(*) OVER w AS n FROM {_weighted(r_cap, floor)} WINDOW {rows(w)}) WHERE n >= {least}))"""


def _positive(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} ELSE 1e-12 END"


def ls_info_gain(w: int = 30) -> str:
    n = w
    band = f"1.959963984540054e0 * sqrt(2e0 / {n - 1} + 2e0 / {n - 2})"
    return f"""SELECT code, ts_ms, round(g, 6) AS ig, round(g - {band}, 6) AS ig_lo, round(g + {band}, 6) AS ig_hi FROM (
  SELECT code, ts_ms, ln({_positive(f"(yy / {n - 1})")} / {_positive(f"((yy - sxy * sxy / sxx) / {n - 2})")}) AS g FROM (
    SELECT code, ts_ms, regr_syy(r, p) OVER w AS yy, regr_sxx(r, p) OVER w AS sxx, regr_sxy(r, p) OVER w AS sxy, count(p) OVER w AS n FROM (
      SELECT code, ts_ms, r, lag(r) OVER (PARTITION BY code ORDER BY ts_ms) AS p FROM {RETURNS} WHERE r IS NOT NULL) WINDOW {rows(w)}) WHERE n = {n} AND sxx > 0)"""


def volume_mgf(w: int = 256, t: float = 0.01) -> str:
    return f"""SELECT code, ts_ms, round(m, 6) AS volume_mgf FROM (SELECT code, ts_ms, avg(exp({t} * volume)) OVER w AS m FROM {{bars}} WHERE volume > 0 WINDOW {rows(w)}) WHERE m < 1e300"""


def volume_autocorr(w: int = 128, lags=(1, 2, 4, 8)) -> str:
    """Mean correlation of the volume with its lags, from running sums: the cost does not grow with the frame."""
    code = "PARTITION BY code ORDER BY ts_ms"
    far = max(lags)
    run = ", ".join(f"coalesce(sum(volume * v{k}) OVER u, 0e0) AS p{k}" for k in lags)
    step = ", ".join(f"p{k} - lag(p{k}, {w}) OVER o AS xy{k}, lag(c, {k}) OVER o - lag(c, {k + w}, 0e0) OVER o AS x{k}, lag(q, {k}) OVER o - lag(q, {k + w}, 0e0) OVER o AS xx{k}" for k in lags)
    each = " + ".join(f"(xy{k} - y * x{k} / {w}e0) / sqrt(nullif((yy - y * y / {w}e0) * (xx{k} - x{k} * x{k} / {w}e0), 0e0))" for k in lags)
    before = ", ".join(f"lag(volume, {k}) OVER ({code}) AS v{k}" for k in lags)
    return f"""SELECT code, ts_ms, round(({each}) / {len(lags)}, 6) AS volume_autocorr FROM (
  SELECT code, ts_ms, n, c - lag(c, {w}) OVER o AS y, q - lag(q, {w}) OVER o AS yy, {step} FROM (
    SELECT code, ts_ms, row_number() OVER ({code}) AS n, sum(volume) OVER u AS c, sum(volume * volume) OVER u AS q, {run} FROM (
      SELECT code, ts_ms, volume, {before} FROM {{bars}} WHERE volume > 0) WINDOW u AS ({code} ROWS UNBOUNDED PRECEDING)) WINDOW o AS ({code})) WHERE n >= {w + far}"""


def prob_momentum(w: int = 60, least_weight: float = 1.0, floor: float = 1e-6) -> str:
    return f"""SELECT code, ts_ms, round(f, 6) AS prob_up, CASE WHEN f >= 7e-1 THEN 1 WHEN f <= 3e-1 THEN -1 ELSE 0 END AS prob_signal FROM (
  SELECT code, ts_ms, {normal_cdf("t")} AS f FROM (
    SELECT code, ts_ms, mu / CASE WHEN v > 0 THEN sqrt(v) ELSE {floor} END AS t FROM (
      SELECT code, ts_ms, a / s AS mu, b / s - (a / s) * (a / s) AS v FROM (
        SELECT code, ts_ms, sum(u) OVER w AS s, sum(u * r) OVER w AS a, sum(u * r * r) OVER w AS b, count(*) OVER w AS n FROM (
          SELECT code, ts_ms, r, CASE WHEN volume > 0 THEN volume ELSE 1e0 END AS u FROM {RETURNS} WHERE r IS NOT NULL) WINDOW {rows(w)}) WHERE n = {w} AND s >= {least_weight})))"""


def volume_ar_forecast(w: int = 120, ma: int = 20, h: int = 5) -> str:
    steps, now = [], "lv"
    for _ in range(h):
        now = f"(a + b * {now})"
        steps.append(f"exp({now})")
    return f"""SELECT code, ts_ms, round(ln((({" + ".join(steps)}) / {h}) / (m + 1e-12)), 6) AS vol_ar1_pred_ratio FROM (
  SELECT code, ts_ms, lv, regr_slope(lv, p) OVER w AS b, regr_intercept(lv, p) OVER w AS a, avg(volume) OVER u AS m, count(p) OVER w AS n FROM (
    SELECT code, ts_ms, volume, ln(volume) AS lv, lag(ln(volume)) OVER (PARTITION BY code ORDER BY ts_ms) AS p FROM {{bars}} WHERE volume > 0) WINDOW {rows(w - 1)}, {rows(ma, "u")}) WHERE n = {w - 1} AND b IS NOT NULL"""


def gaussian_rank(w: int = 250, source: str = RETURNS, x: str = "r") -> str:
    """Rank of the newest value in its window, by default of a close return, as a normal score."""
    return f"""SELECT code, ts_ms, round({normal_ppf("u")}, 6) AS z FROM (
  SELECT code, ts_ms, {clamp("(k - 5e-1) / n", 0.000001, 0.999999)} AS u FROM (
    SELECT code, ts_ms, {{count_le:xs:r}} AS k, n FROM (
      SELECT code, ts_ms, {x} AS r, {{list}}({x}) OVER w AS xs, count(*) OVER w AS n FROM {source} WHERE {x} IS NOT NULL WINDOW {rows(w)})))""".replace("1e-06e0", "1e-6")


def high_volume(w: int = 240, q: float = 0.8) -> str:
    """Threshold, whether the bar is high, and the age of its run."""
    return f"""SELECT code, ts_ms, round(thr, 6) AS threshold, high AS is_high, CASE WHEN high = 1 THEN row_number() OVER (PARTITION BY code, g, high ORDER BY ts_ms) ELSE 0 END AS run_age FROM (
  SELECT *, sum(1 - high) OVER (PARTITION BY code ORDER BY ts_ms) AS g FROM (
    SELECT code, ts_ms, thr, CASE WHEN volume > thr THEN 1 ELSE 0 END AS high FROM (
      SELECT code, ts_ms, volume, {{quantile:volume:{q}}} OVER w AS thr, count(*) OVER w AS n FROM {{bars}} WINDOW {rows(w)}) WHERE n = {w}))"""


def buckets(size: int = 3_600_000) -> str:
    """Bucket sums of quote increments, last mid, and trade and order counts; no empty buckets."""
    return f"""SELECT code, b + {size} AS bucket_end_ms, round(sum(amount), 6) AS amount, CAST(sum(volume) AS BIGINT) AS volume,
  round(coalesce(max(CASE WHEN m = 1 THEN mid END), 0e0), 6) AS midprice, CAST(sum(is_trade) AS BIGINT) AS n_trades, CAST(sum(is_order) AS BIGINT) AS n_orders FROM (
  SELECT *, CASE WHEN mid IS NOT NULL THEN row_number() OVER (PARTITION BY code, b, CASE WHEN mid IS NULL THEN 0 ELSE 1 END ORDER BY ts_ms DESC, seq DESC) END AS m FROM (
    SELECT code, ts_ms, seq, ts_ms - ts_ms % {size} AS b, turnover - coalesce(lag(turnover) OVER d, 0e0) AS amount, greatest(volume - coalesce(lag(volume) OVER d, 0), 0) AS volume,
           CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2e0 END AS mid, 0 AS is_trade, 0 AS is_order FROM {{quotes}} WHERE {in_session("ts_ms")} WINDOW d AS (PARTITION BY code, trading_day ORDER BY ts_ms, seq)
    UNION ALL SELECT code, ts_ms, seq, ts_ms - ts_ms % {size}, 0e0, 0, NULL, 1, 0 FROM {{trades}} WHERE {in_session("ts_ms")}
    UNION ALL SELECT code, ts_ms, seq, ts_ms - ts_ms % {size}, 0e0, 0, NULL, 0, 1 FROM {{orders}} WHERE {in_session("ts_ms")})) GROUP BY code, b"""


#: Quotes, trades and orders of a code in order of arrival, numbered by the quotes met so far.
_TAGGED = """(SELECT *, sum(CASE WHEN src = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY ts_ms, src, seq ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT code, ts_ms, seq, 0 AS src, CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2e0 ELSE 0e0 END AS mid, 0e0 AS price, 0 AS side, 0 AS volume FROM {quotes}
  UNION ALL SELECT code, ts_ms, seq, 1, 0e0, price, side, volume FROM {trades} UNION ALL SELECT code, ts_ms, seq, 2, 0e0, price, side, volume FROM {orders}))"""
_TICKS = "(SELECT *, min(CASE WHEN src = 0 THEN ts_ms END) OVER (PARTITION BY code, k) AS opened FROM " + _TAGGED + ")"


def intervals() -> str:
    """Trades and orders between two quotes, at the closing quote; ticks at the opening quote's own time are dropped."""
    return f"""SELECT q.code, q.ts_ms, q.seq, round(coalesce(a.amount, 0e0), 6) AS tick_amount, CAST(coalesce(a.volume, 0) AS BIGINT) AS tick_volume, round(q.mid, 6) AS tick_midprice,
  CAST(coalesce(a.n_trades, 0) AS BIGINT) AS n_trades, CAST(coalesce(a.n_orders, 0) AS BIGINT) AS n_orders
  FROM (SELECT code, ts_ms, seq, mid, k FROM {_TAGGED} WHERE src = 0 AND k > 1) q LEFT JOIN (
  SELECT code, k + 1 AS k, sum(CASE WHEN src = 1 THEN price * volume END) AS amount, sum(CASE WHEN src = 1 THEN volume END) AS volume, count(CASE WHEN src = 1 THEN 1 END) AS n_trades, count(CASE WHEN src = 2 THEN 1 END) AS n_orders
  FROM {_TICKS} WHERE src > 0 AND ts_ms > opened GROUP BY code, k) a ON q.code = a.code AND q.k = a.k"""


def order_flow() -> str:
    """Order-flow imbalance up to each quote: signed by side, and with every side but buys negative."""
    return f"""SELECT code, ts_ms, seq, CAST(coalesce(ofi, 0) AS BIGINT) AS ofi, CAST(coalesce(ofi_strict, 0) AS BIGINT) AS ofi_strict, CAST(coalesce(v, 0) AS BIGINT) AS order_volume FROM (
  SELECT q.code, q.ts_ms, q.seq, a.ofi, a.ofi_strict, a.v FROM (SELECT code, ts_ms, seq, k FROM {_TAGGED} WHERE src = 0) q LEFT JOIN (
    SELECT code, k + 1 AS k, sum(side * volume) AS ofi, sum(CASE WHEN side > 0 THEN volume ELSE -volume END) AS ofi_strict, sum(volume) AS v FROM {_TAGGED} WHERE src = 2 GROUP BY code, k) a ON q.code = a.code AND q.k = a.k)"""


def latest(n: int = 3) -> str:
    """Bus reads: the last n returns of every code, oldest first."""
    return f"SELECT code, ts_ms, round(r, 6) AS r, CAST({n} + 1 - k AS BIGINT) AS place FROM (SELECT code, ts_ms, r, row_number() OVER (PARTITION BY code ORDER BY ts_ms DESC) AS k FROM {RETURNS} WHERE r IS NOT NULL) WHERE k <= {n}"


def next_returns() -> str:
    """The log return from each bar to the next; the last bar and bars without a price have none."""
    return "SELECT code, ts_ms, round(ln(n / close), 6) AS next_return FROM (SELECT code, ts_ms, close, lead(close) OVER (PARTITION BY code ORDER BY ts_ms) AS n FROM {bars}) WHERE close > 0 AND n > 0"


def rolling_profile(w: int = 250) -> str:
    """Snapshot of the trailing distribution: count, extremes, mean and population deviation."""
    return f"""SELECT code, ts_ms, count(r) OVER w AS n, round(min(r) OVER w, 6) AS lo, round(max(r) OVER w, 6) AS hi, round(avg(r) OVER w, 6) AS mean, round(stddev_pop(r) OVER w, 6) AS sd FROM {RETURNS} WHERE r IS NOT NULL WINDOW {rows(w)}"""


FACTORS = {
    "ret_logvol_corr": ret_logvol_corr(), "ar1_return": ar1(), "wls_drift_z": wls_drift_z(), "wls_drift_z_wide": wls_drift_z(r_cap=10.0), "bayes_drift_logodds": bayes_drift_logodds(),
    "ls_info_gain": ls_info_gain(), "volume_mgf": volume_mgf(), "volume_autocorr": volume_autocorr(), "prob_momentum": prob_momentum(), "volume_ar_forecast": volume_ar_forecast(),
    "gaussian_rank": gaussian_rank(), "high_volume_runs": high_volume(), "time_buckets": buckets(), "tick_intervals": intervals(), "order_flow": order_flow(), "bus_last_n": latest(), "next_returns": next_returns(), "rolling_profile": rolling_profile(),
}


def _tokens(sql: str, dialect: str) -> str:
    import re

    own = DIALECTS[dialect]
    sql = re.sub(r"\{count_le:(\w+):(\w+)\}", lambda m: own["count_le"].format(xs=m[1], x=m[2]), sql)
    sql = re.sub(r"\{quantile:(\w+):([\d.]+)\}", lambda m: own["quantile"].format(x=m[1], q=m[2]), sql)
    return sql.replace("{list}", own["list"]).replace("{div}", own["div"])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Evaluate a factor text over the views of a directory."""
    sql = _tokens(sql, "spark")
    return spark.sql(sql, **{name: view(spark, sf_dir) for name, view in VIEWS.items() if "{" + name + "}" in sql})


def check_sql(sql: str) -> str:
    sql = _tokens(sql, "check")
    for name, text in SQL.items():
        sql = sql.replace("{" + name + "}", text)
    return sql
