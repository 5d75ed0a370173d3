import math
import statistics

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import kernel_factors as kf
from tidemark.operators import kernels as k

rng = np.random.default_rng(0)


def test_hawkes_recursion():
    n = rng.integers(0, 2, 40)
    level, got = 0.1, k.hawkes(n)
    for i, x in enumerate(n):
        level = 0.1 + math.exp(-1.2) * (level - 0.1) + 0.3 * x
        assert abs(got[i] - level) < 1e-12


def test_f_survival_against_simulation_and_identities():
    assert abs(k.f_survival(1.0, 7, 7) - 0.5) < 1e-12  # the median of equal degrees
    assert abs(k.f_survival(4.0, 2, 10) - (1 + 2 * 4.0 / 10) ** -5) < 1e-12  # closed form for two degrees
    for f, a, b in ((0.3, 3, 9), (2.7, 5, 40)):
        x = (rng.chisquare(a, 400_000) / a) / (rng.chisquare(b, 400_000) / b)
        assert abs(k.f_survival(f, a, b) - (x > f).mean()) < 4e-3


def test_granger_finds_the_cause():
    n = 200
    x = np.where(np.arange(n) % 4 < 2, 1.0, -1.0) * rng.uniform(0.5, 1.5, n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.3 * y[t - 1] + 0.8 * x[t - 1] + 0.05 * rng.standard_normal()
    strength, p = k.granger(y, x)
    assert strength[100:].min() > 5 and p[100:].max() < 1e-5
    strength, _ = k.granger(rng.standard_normal(n), x)
    assert np.nanmedian(strength) < 1.5
    assert np.isnan(strength[:14]).all() and np.isfinite(strength[20])


def test_copula_gate_and_range():
    w, n = 20, 80
    r = rng.standard_normal(n)
    out = k.copula(rng.standard_normal(n), rng.uniform(1, 9, n), r, w)
    assert np.isnan(out[: 2 * w - 2]).all() and np.isfinite(out[2 * w - 2 :]).all()
    assert (np.abs(out[2 * w - 2 :]) <= np.abs(r).max()).all()


def test_kalman_follows_a_trend():
    close = np.exp(0.01 * np.arange(120))
    z = k.kalman_z(close, close * 1.002, close * 0.998)
    assert np.isnan(z[:59]).all() and (z[80:] > 0).all()
    assert (k.kalman_z(1 / close, 1.002 / close, 0.998 / close)[80:] < 0).all()


def test_spectrum_and_acf():
    t = np.arange(300)
    slow, fast = k.spectral(np.sin(2 * np.pi * t / 64)), k.spectral(np.sin(2 * np.pi * t / 4))
    assert slow["ret_spec_lowfreq_ratio"].min() > 0.99 and fast["ret_spec_lowfreq_ratio"].max() < 0.01
    assert slow["ret_spec_centroid"].mean() < fast["ret_spec_centroid"].mean()
    x = rng.standard_normal((1, 50))
    c = x[0] - x[0].mean()
    assert abs(k.acf(x, 5)[0, 3] - (c[3:] * c[:-3]).sum() / (c * c).sum()) < 1e-12


def test_transitions_have_unit_eigenvalue():
    e = k.symbolic(rng.uniform(-0.05, 0.05, 400))
    assert ((0.8 <= e) & (e <= 1.05)).all()


def test_wavelet_signs():
    up = k.wavelet_energy(100 + np.arange(300.0))
    assert np.isnan(up[:128]).all() and (up[128:] >= 0).all() and (up[128:] <= 1).all()
    assert (k.wavelet_energy(400 - np.arange(300.0))[140:] <= 0).all()
    assert (np.abs(k.DB4.sum() - math.sqrt(2)) < 1e-9) and abs((k.DB4**2).sum() - 1) < 1e-9


def test_haar_ssa_dmd():
    close = np.exp(0.02 * np.arange(100))
    assert (k.haar_trend(close) > 0.9).all()
    slope, share = k.ssa(close)
    assert np.allclose(slope, 0.02, atol=1e-6) and (share > 0.99).all()
    assert np.allclose(k.dmd_growth(np.exp(1.03 ** np.arange(60))), math.log(1.03), atol=1e-6)


def test_oja_is_steady():
    r = np.full(300, 0.0005)
    _, steady = k.pca_factors(r, np.full(300, 10.0), 1000 + np.arange(300) % 50, (1000 + np.arange(300) % 50) * 10.0)
    assert np.isnan(steady[:64]).all() and np.nanmean(steady[-100:]) > 0.95


def test_runs_and_crossings():
    v = np.where(np.arange(700) % 10 < 3, 5000.0, 1000.0)
    out = k.high_remaining(v, w=240, q=0.6)
    assert np.isnan(out[:239]).all() and set(np.round(out[400:], 6)) == {0.0, 1.0, 2.0}
    assert np.allclose(k.zero_cross(np.where(np.arange(80) % 2, 1.0, -1.0)), 1.0)


def test_hmm_and_bma():
    up = k.hmm_uptrend(np.r_[np.full(50, 0.01), np.full(50, -0.01)])
    assert up[40] > 0.9 and up[-1] < 0.1
    assert np.allclose(k.bma_drift(np.full(60, 0.002)), 0.002)


def test_loading_is_canonical():
    r = rng.standard_normal(80)
    v = k.first_loading(r, r * 0.5 + 0.01 * rng.standard_normal(80), 0.01 * rng.standard_normal(80))
    assert (v > 0.8).all()


def test_memory_kernel_weights():
    x = rng.standard_normal(200)
    assert (np.abs(k.memory_kernel(x)) < 1).all() and k.memory_kernel(x).size == 73


def test_ppf_in_copula_matches():
    assert abs(float(k._phi(statistics.NormalDist().inv_cdf(0.3))) - 0.3) < 1e-12


@pytest.mark.parametrize("name", sorted(kf.QUERIES))
def test_passes_are_isolated_by_code(spark, name):
    rows = kf.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) and np.isfinite(rows.value).all()
    assert rows.groupby("topic").code.nunique().max() >= 10


def test_short_and_bad_inputs():
    pdf = pd.DataFrame({"code": [1, 1], "ts_ms": [1, 2], "close": [0.0, -1.0], "high": [0.0, 0.0], "low": [0.0, 0.0], "volume": [0.0, 0.0], "turnover": [0.0, 0.0]})
    for fn in [*kf.KERNELS.values(), *kf.RANGE_KERNELS.values()]:
        assert len(kf._kernel(fn)(pdf)) == 0 and len(kf._kernel(fn)(pdf.assign(close=[0.0, 2.0]))) == 0
        two = kf._kernel(fn)(pdf.assign(close=[1.0, 2.0]))
        assert len(two) == 0
    empty = pd.DataFrame({"code": [1], "ts_ms": [1], "seq": [1], "bid": [1.0], "ask": [1.0], "ofi": [0], "ofi_strict": [0], "order_volume": [0]})
    assert len(kf.granger_kernel(empty)) == 0 and len(kf.copula_kernel(empty)) == 0


def plain_granger(y, x, w, p=2, q=2, least=16):
    """Least squares a row at a time."""
    out = np.full(y.size, np.nan)
    for t in range(y.size):
        n, i = min(t + 1, w), np.arange(max(p, q, t + 1 - w), t + 1)
        if n < max(least, p + q + 4):
            continue
        own = np.column_stack([np.ones(i.size), y[i - 1], y[i - 2]])
        full = np.column_stack([own, x[i - 1], x[i - 2]])
        one, two = (((y[i] - a @ np.linalg.lstsq(a, y[i], rcond=None)[0]) ** 2).sum() for a in (own, full))
        out[t] = k.f_survival((one - two) / q / (two / (n - p - q - 1)), q, n - p - q - 1)
    return out


def test_granger_equals_least_squares():
    y, x = rng.standard_normal(300), rng.integers(0, 9, 300).astype(float)
    _, p = k.granger(y, x, 60)
    want = plain_granger(y, x, 60)
    assert np.array_equal(np.isnan(p), np.isnan(want)) and np.allclose(p, want, atol=1e-9, equal_nan=True)
    assert np.isnan(k.granger(y, np.zeros(300), 60)[0]).all()  # lags that say nothing leave the equations open


def test_copula_equals_a_plain_one():
    n, w, q = 70, 12, statistics.NormalDist().inv_cdf
    ofi, volume, r = rng.integers(-3, 4, n).astype(float), rng.integers(0, 5, n).astype(float), rng.standard_normal(n)
    z = []
    for t in range(w - 1, n):
        z.append([q(min(max(((v[t - w + 1 : t + 1] < v[t]).sum() + 0.5 * (v[t - w + 1 : t + 1] == v[t]).sum()) / w, 1e-6), 1 - 1e-6)) for v in (ofi, volume, r)])
    got = k.copula(ofi, volume, r, w)
    for t in range(2 * w - 2, n):
        own = np.array(z[t - 2 * w + 2 : t - w + 2])
        cov, mu = np.cov(own.T) + 1e-6 * np.eye(3), own.mean(0)
        e = mu[2] + cov[2, :2] @ np.linalg.solve(cov[:2, :2], own[-1, :2] - mu[:2])
        assert abs(got[t] - np.quantile(r[t - w + 1 : t + 1], statistics.NormalDist().cdf(e))) < 1e-9


def test_flow_is_held_until_a_sample(monkeypatch):
    seen = []
    monkeypatch.setattr(k, "granger", lambda y, x, w: seen.append(x) or (np.full(y.size, 1.0), np.full(y.size, 1.0)))
    monkeypatch.setattr(k, "copula", lambda a, b, r, w: seen.append((a, b)) or np.full(r.size, 1.0))
    quotes = pd.DataFrame({"code": 1, "ts_ms": [1, 2, 3, 4, 5], "seq": 1, "bid": [1.0, 1.1, 0.0, 1.2, 1.3], "ask": [1.0, 1.1, 1.0, 1.2, 1.3], "ofi": [5, 1, 2, 3, 4], "ofi_strict": [5, 1, 2, 3, 4], "order_volume": [5, 1, 2, 3, 4]})
    kf.granger_kernel(quotes)
    kf.copula_kernel(quotes)
    assert seen[0].tolist() == [6.0, 5.0, 4.0]  # before the first quote, and over the bad one
    assert seen[1][0].tolist() == seen[1][1].tolist() == [6.0, 2.0, 3.0, 4.0]


def test_ssa_and_dmd_equal_a_window_alone():
    close = np.exp(np.cumsum(rng.standard_normal(90) * 0.01))
    slope, share = k.ssa(close)
    x = np.log(close[17 : 17 + 40])
    h = np.array([x[i : i + 31] for i in range(10)])
    u, s, v = np.linalg.svd(h, full_matrices=False)
    low = (u[:, :2] * s[:2]) @ v[:2]
    line = [np.mean([low[i, p - i] for i in range(10) if 0 <= p - i < 31]) for p in range(35, 40)]
    assert abs(slope[17] - np.polyfit(np.arange(5), line, 1)[0]) < 1e-9 and abs(share[17] - (s[:2] ** 2).sum() / (s**2).sum()) < 1e-9
    h = np.array([x[i : i + 37] for i in range(4)])
    u, s, v = np.linalg.svd(h[:, :-1], full_matrices=False)
    a = u[:, :2].T @ h[:, 1:] @ v[:2].T @ np.diag(1 / s[:2])
    assert abs(k.dmd_growth(close)[17] - np.log(np.abs(np.linalg.eigvals(a)).max())) < 1e-9


def test_angular_momentum_reads_raw_features():
    r, close = rng.standard_normal(80) * 0.01, 10 + rng.uniform(size=80)
    volume, turnover = rng.integers(1, 99, 80).astype(float), np.zeros(80)  # without turnover the close stands in
    x = np.column_stack([r, np.log1p(volume), np.log(close)])
    w = [v.copy() for _, v in k.oja(x, 2)]
    u = [w[t] @ x[t] for t in range(80)]
    got = k.pca_factors(r, close, volume, turnover)[0]
    assert np.isnan(got[:64]).all() and abs(got[70] - abs(u[69][0] * u[70][1] - u[69][1] * u[70][0])) < 1e-12
