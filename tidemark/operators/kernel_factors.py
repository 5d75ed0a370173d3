"""The numpy kernels over DataFrames: one grouped pass per source runs all kernels of a code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


from ..sources.views import bars, tick_bars
from . import kernels as k
from .event_factors import MIDS_AND_TRADES, PRICES
from .sql_factors import _TAGGED, order_flow, run

LONG = "code long, ts_ms long, topic string, value double"


def _long(code, ts, columns: dict) -> pd.DataFrame:
    """Finite values of the columns, aligned to the end of ts, as long rows."""
    parts = [pd.DataFrame({"code": pd.Series([], dtype="int64"), "ts_ms": pd.Series([], dtype="int64"), "topic": pd.Series([], dtype=str), "value": pd.Series([], dtype=float)})]
    for topic, v in columns.items():
        v = k.late(np.asarray(v, float), ts.size)
        ok = np.isfinite(v)
        parts.append(pd.DataFrame({"code": code, "ts_ms": ts[ok], "topic": topic, "value": np.round(v[ok], 6)}))
    return pd.concat(parts, ignore_index=True)


class Bars:
    """A code's bars in order of time as arrays; priced: only those with a close, and their returns from the second on."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("ts_ms")
        self.code, self.raw_ts, self.raw_volume = pdf.code.iloc[0], pdf.ts_ms.to_numpy(), pdf.volume.to_numpy(float)
        pdf = pdf[pdf.close > 0]
        self.ts, self.close, self.volume, self.turnover, self.high, self.low = (pdf[c].to_numpy(float if c != "ts_ms" else None) for c in ("ts_ms", "close", "volume", "turnover", "high", "low"))
        self.r = k.log_returns(self.close)[1:] if self.close.size else np.empty(0)


def _from(values: np.ndarray, warmup: int) -> np.ndarray:
    return np.where(np.arange(values.size) >= warmup - 1, values, np.nan)


def _hmm(b: Bars) -> dict:
    up = k.hmm_uptrend(b.r)
    ahead = up * 0.9 + (1 - up) * 0.1
    return {"kline_new/hmm_uptrend_prob": _from(up, 40), "kline_new/hmm_next_drift": _from(0.006 * ahead - 0.006 * (1 - ahead), 40)}


def _pca(b: Bars) -> tuple[np.ndarray, np.ndarray]:
    return k.pca_factors(b.r, b.close[1:], b.volume[1:], b.turnover[1:])


def _pca1(b: Bars) -> dict:
    """Bars without volume are left out before the return; a bad high or low is no amplitude."""
    ok = b.volume > 0
    close, high, low = b.close[ok], b.high[ok], b.low[ok]
    amplitude = np.where((high > 0) & (low > 0), (high - low) / np.maximum(low, 1e-12), 0.0)
    loading = k.first_loading(k.log_returns(close)[1:], np.log(b.volume[ok][1:]), amplitude[1:]) if close.size else np.empty(0)
    out = np.full(b.ts.size, np.nan)
    out[ok] = k.late(loading, close.size)
    return {"kline/pv_pca1_ret_loading": out}


#: Kernels of a code's bars: topics and their values, aligned to the end of the priced bars.
KERNELS = {
    "hmm2_logodds": lambda b: {"kline/hmm2_logodds": _from(k.logit(k.hmm_uptrend(np.clip(b.r, -0.2, 0.2))), 60)}, "hmm_uptrend": _hmm,
    "ma_zero_cross": lambda b: {"kline/ma_zero_cross_rate": k.zero_cross(b.close)}, "low_freq_return": lambda b: {"kline/ret_lowfreq_mu10": k.low_freq_return(b.r)},
    "spectral_autocorr": lambda b: {f"kline/{n}": v for n, v in k.spectral(b.r).items()},
    "pca_angular_momentum": lambda b: {"space/pca_angmom": _pca(b)[0]}, "pca_structure_stability": lambda b: {"space/pca_stability": _pca(b)[1]},
    "symbolic_transition": lambda b: {"time/symbolic_eig1": k.symbolic(b.r)}, "memory_kernel": lambda b: {"memory_kernel/decay": k.memory_kernel(b.r)},
    "wavelet_trend_energy": lambda b: {"wave_trend/energy_ratio": k.wavelet_energy(b.close)}, "haar_wavelet_trend": lambda b: {"kline_new/haar_trend_energy": k.haar_trend(b.close)},
    "ssa_trend_slope": lambda b: dict(zip(("kline_new/ssa_trend_slope", "kline_new/ssa_energy_ratio"), k.ssa(b.close), strict=True)),
    "dmd_growth_rate": lambda b: {"kline_new/dmd_growth_rate": k.dmd_growth(b.close)}, "bma_ensemble_drift": lambda b: {"kline_new/bma_ensemble_drift": k.bma_drift(b.r)},
}
#: Those that need highs and lows: over tick bars, whose highs and lows differ.
RANGE_KERNELS = {"kalman_forecast_z": lambda b: {"kline/kalman_forecast_z": k.kalman_z(b.close, b.high, b.low)}, "volume_price_pca1": _pca1}


def _kernel(fn):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Bars(pdf)
        return _long(b.code, b.ts, fn(b) if b.close.size > 1 else {})

    return run


def high_remaining_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    b = Bars(pdf)
    return _long(b.code, b.raw_ts, {"kline/vol_high_remaining": k.high_remaining(b.raw_volume)})


def event_kernels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hawkes intensity of a code's ticks (trades 1, orders 0), late events dropped."""
    pdf = pdf.sort_values(["ts_ms", "src", "seq"])
    return _long(pdf.code.iloc[0], pdf.ts_ms.to_numpy(), {"time/hawkes_intensity": k.hawkes((pdf.src == 1).to_numpy(float))})


def granger_kernel(pdf: pd.DataFrame, w: int = 240) -> pd.DataFrame:
    """Order flow for the change of a valid mid: flow is held over invalid quotes until a sample is made."""
    pdf = pdf.sort_values(["ts_ms", "seq"])
    valid = ((pdf.bid > 0) & (pdf.ask > 0)).to_numpy()
    mid, ts, flow = ((pdf.bid + pdf.ask) / 2).to_numpy(float)[valid], pdf.ts_ms.to_numpy()[valid], np.cumsum(pdf.ofi_strict.to_numpy(float))[valid]
    if mid.size < 3:
        return _long(pdf.code.iloc[0], ts, {})
    strength, pval = k.granger(np.diff(mid), np.diff(np.concatenate([[0.0], flow[1:]])), w)
    return _long(pdf.code.iloc[0], ts[1:], {"granger/strength": strength, "granger/pval": pval})


def copula_kernel(pdf: pd.DataFrame, w: int = 30) -> pd.DataFrame:
    """A sample at every quote but the first, whose flow counts for the second; mids without a finite return make none."""
    pdf = pdf.sort_values(["ts_ms", "seq"])
    mid, ts, flow = ((pdf.bid + pdf.ask) / 2).to_numpy(float), pdf.ts_ms.to_numpy(), pdf[["ofi", "order_volume"]].to_numpy(float)
    if mid.size < 2:
        return _long(pdf.code.iloc[0], ts, {})
    flow[1] += flow[0]
    with np.errstate(all="ignore"):
        r = np.log(mid[1:] / mid[:-1])
    ok = np.isfinite(r)
    return _long(pdf.code.iloc[0], ts[1:][ok], {"gaussian_copula/prediction": k.copula(flow[1:, 0][ok], flow[1:, 1][ok], r[ok], w)})


def _over(view, fn):
    return lambda spark, sf_dir: view(spark, sf_dir).groupBy("code").applyInPandas(fn, LONG)


def hawkes_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = run(spark, sf_dir, f"SELECT code, ts_ms, seq, src FROM {_TAGGED} WHERE src > 0")
    return ticks.groupBy("code").applyInPandas(event_kernels, LONG)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, ts_ms, seq, ofi, ofi_strict, order_volume, bid, ask) of every quote."""
    return run(spark, sf_dir, f"SELECT f.*, q.bid, q.ask FROM ({order_flow()}) f JOIN {{quotes}} q ON f.code = q.code AND f.ts_ms = q.ts_ms AND f.seq = q.seq")


#: Windows of Granger and the copula as registered: the test views have few rows per code (survey section 7.2).
FLOW_WINDOWS = (60, 20)


def _on_prices(topic: str, fn):
    """A kernel over the prices of events, in order of arrival."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival")
        return _long(pdf.code.iloc[0], pdf.arrival.to_numpy(), {topic: fn(pdf.close.to_numpy(float))}).rename(columns={"ts_ms": "arrival"})

    return one


def event_query(topic: str, fn, text: str):
    return lambda spark, sf_dir: run(spark, sf_dir, text).groupBy("code").applyInPandas(_on_prices(topic, fn), LONG.replace("ts_ms", "arrival"))


QUERIES = {
    **{name: _over(bars, _kernel(fn)) for name, fn in KERNELS.items()}, **{name: _over(tick_bars, _kernel(fn)) for name, fn in RANGE_KERNELS.items()},
    "high_volume_remaining": _over(bars, high_remaining_kernel), "hawkes_intensity": hawkes_factor,
    "granger_causality": _over(flow, lambda pdf: granger_kernel(pdf, FLOW_WINDOWS[0])), "gaussian_copula": _over(flow, lambda pdf: copula_kernel(pdf, FLOW_WINDOWS[1])),
    "event_wavelet_energy": event_query("wave_trend/energy_ratio", k.wavelet_energy, PRICES), "event_symbolic": event_query("time/symbolic_eig1", lambda price: k.symbolic(k.log_returns(price)[1:]), MIDS_AND_TRADES),
}


def hawkes_sql() -> str:
    """The recursion unrolled into its closed form over the events so far, for the check engine."""
    from .sql_factors import check_sql

    return check_sql(f"""SELECT code, ts_ms, 'time/hawkes_intensity' AS topic, round(1e-1 + 3e-1 * list_sum(list_transform(xs, lambda x, i: x * exp(-1.2e0 * (len(xs) - i)))), 6) AS value FROM (
  SELECT code, ts_ms, list(CASE WHEN src = 1 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY code ORDER BY ts_ms, src, seq ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS xs FROM {_TAGGED} WHERE src > 0)""")

