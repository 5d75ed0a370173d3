"""From a factor to a position: rank-Gaussian scores, threshold search, equity and drawdown.

The calendar of a code is the bars that have a next log return; a factor is joined to it from the left, and
days without a value are flat.  Scores come from a trailing window.  The calendar is split by place into
train, validation and test: the distribution's kind, the score cap and the risk scale come from train, the
best candidate from validation, and the path is built over all rows.

A code's calendar is one group of one Arrow pass (some thousand days); all thresholds are evaluated side by
side, once for each query.  plans/leverage_check.py holds the same definitions as SQL, written separately.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql_factors import RETURNS, ar1, run, volume_ar_forecast

# fixed values: the defaults of the search
WINDOW, TRAIN, VALIDATION, MOST_LEVERAGE = 250, 0.6, 0.2, 2.0
THETAS = np.cumsum([0.0] + [0.05] * 50)
RISK_DAYS, YEAR, LEAST_TRADES, CAP = 250, 252.0, 50.0, (0.99, 1.5, 6.0)
DISCRETE, MOST_FREQUENT, SYMMETRIC, GRID = 0.15, 0.03, 0.2, 1e-6
LEAST_FINITE, LEAST_DAYS, LEAST_SPLIT = 30, 60, (20, 10, 10)
SIDES = {"symmetric": ["both"], "asymmetric": ["pos", "neg"], "discrete": ["both", "pos", "neg"]}


def split(n: int, train: float = TRAIN, val: float = VALIDATION) -> tuple[int, int, int]:
    """Days of train, validation and test; shares below 1 are parts of n, others are counts."""
    a = max(LEAST_SPLIT[0], math.floor(train * n) if train < 1 else int(train))
    b = max(LEAST_SPLIT[1], math.floor(val * n) if val < 1 else int(val))
    return a, b, n - a - b


def eligible(n: int, finite: int, parts: tuple[int, int, int]) -> bool:
    return finite >= LEAST_FINITE and n >= LEAST_DAYS and all(p >= least for p, least in zip(parts, LEAST_SPLIT, strict=True))


def scores(x: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Normal score of each value's rank among the last w finite ones; NaN where there is none."""
    out, own = np.full(x.size, np.nan), np.flatnonzero(np.isfinite(x))
    if own.size:
        v = x[own]
        seen = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(w - 1, np.inf), v]), w)
        u = ((seen <= v[:, None]).sum(1) - 0.5) / np.minimum(np.arange(v.size) + 1, w)
        names, at = np.unique(np.clip(u, 1e-6, 1 - 1e-6), return_inverse=True)
        out[own] = np.array([NormalDist().inv_cdf(p) for p in names])[at]
    return out


def quantile(ordered: np.ndarray, p: float) -> float:
    i = min(max(p, 0.0), 1.0) * (ordered.size - 1)
    lo = math.floor(i)
    return ordered[lo] * (1 - (i - lo)) + ordered[min(lo + 1, ordered.size - 1)] * (i - lo)


def profile(x: np.ndarray) -> dict:
    """Kind of a factor's distribution: discrete, symmetric or asymmetric."""
    x = np.sort(x[np.isfinite(x)])
    if not x.size:
        return {"profile_kind": "discrete", "unique_ratio": 0.0, "max_freq_ratio": 0.0, "symmetry_score": np.nan}
    centred = x - np.median(x)
    cell = centred / GRID
    counts = np.unique(np.sign(cell) * np.floor(np.abs(cell) + 0.5), return_counts=True)[1]
    low, mid, high = (quantile(centred, p) for p in (0.1, 0.5, 0.9))
    unique, most, skew = counts.size / x.size, counts.max() / x.size, abs((high + low) / 2 - mid) / max(1e-12, high - low)
    kind = "discrete" if unique < DISCRETE or most > MOST_FREQUENT else "symmetric" if skew <= SYMMETRIC else "asymmetric"
    return {"profile_kind": kind, "unique_ratio": unique, "max_freq_ratio": most, "symmetry_score": skew}


def positions(z: np.ndarray, mode: str, polarity: int, theta, cap, most: float = MOST_LEVERAGE) -> np.ndarray:
    """Raw positions: 0 within the threshold, then from 1 at it up to `most` at the cap."""
    size = 1 + np.clip((np.abs(z) - theta) / (cap - theta), 0, 1) * (most - 1)
    active = {"both": np.abs(z) > theta, "pos": z > theta, "neg": z < -theta}[mode]
    return np.where(active, polarity * np.sign(z) * size, 0.0)


def drawdown(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of gains along the last axis, and how far they are below their peak (0 at least)."""
    e = np.cumsum(gains, axis=-1)
    return e, np.maximum(np.maximum.accumulate(e, axis=-1), 0) - e


def ratio(days: float, energy, gain, squares):
    return np.sqrt(days / energy) * (YEAR / days * gain) / np.sqrt(YEAR / days * squares)


def search(x: np.ndarray, z: np.ndarray, y: np.ndarray, train: int, val: int) -> dict | None:
    """The first candidate of the highest validation score, thresholds in order, then sides, then polarity."""
    own = profile(x[:train])
    size = np.sort(np.abs(z[:train][np.isfinite(z[:train])]))
    if not size.size:
        return None
    cap = np.maximum(min(max(quantile(size, CAP[0]), CAP[1]), CAP[2]), THETAS + 1e-3)[:, None]
    candidates = [(m, p) for m in SIDES[own["profile_kind"]] for p in (1, -1)]
    align, r = min(RISK_DAYS, train), y[train : train + val]
    score, scale = np.full((THETAS.size, len(candidates)), -np.inf), np.zeros((THETAS.size, len(candidates)))
    for k, (mode, polarity) in enumerate(candidates):
        b = positions(z[None, train - align : train + val], mode, polarity, THETAS[:, None], cap)
        energy = (b[:, :align] ** 2).sum(1)
        scale[:, k] = np.sqrt(align / np.where(energy > 1e-12, energy, np.inf))
        held = scale[:, k, None] * b[:, align:]
        dd = (drawdown(held * r)[1] ** 2).sum(1)
        ok = (energy > 1e-12) & ((b[:, align:] != 0).sum(1) >= math.ceil(val / YEAR * LEAST_TRADES - 1e-12)) & ((held**2).sum(1) > 1e-12) & (np.sqrt(dd / val) > 1e-12)
        score[ok, k] = ratio(val, (held[ok] ** 2).sum(1), (held[ok] * r).sum(1), dd[ok])
    if not np.isfinite(score).any():
        return None
    t, k = np.unravel_index(np.argmax(score), score.shape)
    theta, (mode, polarity) = THETAS[t], candidates[k]
    ordered, p = np.sort(x[:train][np.isfinite(x[:train])]), NormalDist().cdf(theta)
    raw = {"raw_threshold_low": quantile(ordered, 1 - p) if mode != "pos" else np.nan, "raw_threshold_high": quantile(ordered, p) if mode != "neg" else np.nan}
    return {**own, "mode": mode, "polarity": float(polarity), "theta": theta, "z_cap": cap[t, 0], "c_scale": scale[t, k], "score": score[t, k], **raw}


def segment(l: np.ndarray, y: np.ndarray) -> dict:
    """Score, buy-and-hold score, end and drawdown of one segment, whose equity begins anew."""
    days, dd, base = float(y.size), (drawdown(l * y)[1] ** 2).sum(), (drawdown(y)[1] ** 2).sum()
    if not ((l * l).sum() > 1e-12 and dd > 1e-12):
        return {"score": np.nan, "baseline_score": np.nan, "final_equity": np.nan, "dd_rms": np.nan, "trade_days": 0}
    hold = ratio(days, days, y.sum(), base) if base > 1e-12 else np.nan
    return {"score": ratio(days, (l * l).sum(), (l * y).sum(), dd), "baseline_score": hold, "final_equity": (l * y).sum(), "dd_rms": math.sqrt(dd / days), "trade_days": int((l != 0).sum())}


SIZES = "code long, n long, n_finite long, n_train long, n_val long, n_test long, eligible int"
_POLICY = "profile_kind string, symmetry_score double, unique_ratio double, max_freq_ratio double, mode string, polarity double, theta double, z_cap double, c_scale double"
BEST = f"code long, {_POLICY}, score double, raw_threshold_low double, raw_threshold_high double"
PATH = f"code long, ts_ms long, split string, factor_raw double, z double, {_POLICY}, b_raw double, leverage double, next_return double, equity double, drawdown double, active int, raw_threshold_low double, raw_threshold_high double"
REPORT = "code long, split string, n long, first_ms long, last_ms long, score double, baseline_score double, final_equity double, dd_rms double, trade_days long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _of_code(kind: str, w: int):
    """A code's rows of one kind: sizes, best, path or report."""
    schema = {"sizes": SIZES, "best": BEST, "path": PATH, "report": REPORT}[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        code, ts, x, y = pdf.code.iloc[0], pdf.ts_ms.to_numpy(), pdf.x.to_numpy(float), pdf.y.to_numpy(float)
        n, finite, parts = len(pdf), int(np.isfinite(x).sum()), split(len(pdf))
        ok = eligible(n, finite, parts)
        if kind == "sizes":
            return pd.DataFrame([(code, n, finite, *parts, int(ok))], columns=_names(schema))
        z = scores(x, w)
        best = search(x, z, y, *parts[:2]) if ok else None
        if best is None:
            return pd.DataFrame({c: [] for c in _names(schema)})
        if kind == "best":
            return pd.DataFrame([{"code": code, **best}])[_names(schema)]
        b = positions(z, best["mode"], best["polarity"], best["theta"], best["z_cap"])
        l, names = best["c_scale"] * b, np.repeat(["train", "val", "test"], parts)
        if kind == "report":
            rows = [{"code": code, "split": s, "n": m, "first_ms": ts[names == s][0], "last_ms": ts[names == s][-1], **segment(l[names == s], y[names == s])} for s, m in zip(("train", "val", "test"), parts, strict=True)]
            return pd.DataFrame(rows)[_names(schema)]
        e, dd = drawdown(l * y)
        own = {"code": code, "ts_ms": ts, "split": names, "factor_raw": x, "z": z, "b_raw": b, "leverage": l, "next_return": y, "equity": e, "drawdown": dd, "active": (b != 0).astype(int)}
        return pd.DataFrame({**{k: v for k, v in best.items() if k != "score"}, **own}, index=range(n))[_names(schema)]

    return run, schema


def calendar(spark: SparkSession, sf_dir: str, factor: str = RETURNS, value: str = "r") -> DataFrame:
    """(code, ts_ms, x, y): the next log return of every bar that has one, and the factor's value there."""
    return run(spark, sf_dir, f"""SELECT c.code, c.ts_ms, f.x, c.y FROM (
  SELECT code, ts_ms, ln(n / close) AS y FROM (SELECT code, ts_ms, close, lead(close) OVER (PARTITION BY code ORDER BY ts_ms) AS n FROM {{bars}}) WHERE close > 0 AND n > 0) c
  LEFT JOIN (SELECT code, ts_ms, {value} AS x FROM ({factor})) f ON c.code = f.code AND c.ts_ms = f.ts_ms""")


def over(days: DataFrame, kind: str, w: int = WINDOW) -> DataFrame:
    """Rows of a kind (sizes, best, path, report) of every code of (code, ts_ms, x, y)."""
    fn, schema = _of_code(kind, w)
    return days.groupBy("code").applyInPandas(fn, schema)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.when(~F.isnan(c), F.round(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _query(kind: str, columns: list[str] | None = None, digits: int = 6, factor: str = RETURNS, value: str = "r"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = _rounded(over(calendar(spark, sf_dir, factor, value), kind), digits)
        return done.select(*columns) if columns else done

    return query


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and the deepest drawdown of the whole path in every segment of every code."""
    path = over(calendar(spark, sf_dir), "path")
    return path.groupBy("code", "split").agg(F.count("*").alias("n"), F.round(F.sum(F.col("leverage") * F.col("next_return")), 4).alias("gain"), F.round(F.sum("next_return"), 4).alias("hold"), F.round(F.max("drawdown"), 4).alias("worst"))


_SEARCH = ["code", "mode", "polarity", "theta", "c_scale", "score"]
QUERIES = {
    "leverage_eligible": _query("sizes"), "leverage_profile": _query("best", ["code", "profile_kind", "unique_ratio", "max_freq_ratio", "symmetry_score", "z_cap"]),
    "leverage_search": _query("best", _SEARCH), "leverage_thresholds": _query("best", ["code", "mode", "theta", "raw_threshold_low", "raw_threshold_high"]),
    "leverage_path": _query("path", digits=5), "leverage_report": _query("report", digits=4), "leverage_segments": segments,
    "leverage_ar1_return": _query("best", _SEARCH, factor=ar1(), value="ar1_return_coeff"), "leverage_volume_ar_forecast": _query("best", _SEARCH, factor=volume_ar_forecast(), value="vol_ar1_pred_ratio"),
}
