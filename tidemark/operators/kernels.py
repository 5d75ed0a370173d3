"""Order-dependent and linear-algebra factors as numpy kernels: arrays of one code in, arrays out.

NaN means that nothing is published.  Definitions that the survey infers are marked "adopted".
"""

from __future__ import annotations

import math

import numpy as np

NAN = np.nan
_phi = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])


def log_returns(price: np.ndarray) -> np.ndarray:
    out = np.full(price.size, NAN)
    out[1:] = np.log(price[1:] / price[:-1])
    return out


def windows(x: np.ndarray, w: int) -> np.ndarray:
    """All full windows; window k ends at place k + w - 1."""
    return np.lib.stride_tricks.sliding_window_view(x, w) if x.size >= w else np.empty((0, w))


def late(values: np.ndarray, n: int) -> np.ndarray:
    """Values of the last places of n, NaN before."""
    return np.concatenate([np.full(n - values.size, NAN), values])


def logit(p: np.ndarray, cap: float = 50.0) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.clip(np.log(p / (1 - p)), -cap, cap)


def hawkes(events: np.ndarray, mu=0.1, alpha=0.3, beta=1.2, dt=1.0) -> np.ndarray:
    """Intensity after every event: decay by the constant step, then a jump per trade."""
    out, level, keep = np.empty(events.size), mu, math.exp(-beta * dt)
    for i, n in enumerate(events):
        level = mu + keep * (level - mu) + alpha * n
        out[i] = level
    return out


def hmm_uptrend(r: np.ndarray, mu=(0.006, -0.006), sd=(0.010, 0.012), stay=(0.9, 0.9), start=0.5) -> np.ndarray:
    """Filtered probability of the first of two Gaussian states (adopted: forward filter from the start)."""
    edge = np.log(sd[0] / sd[1]) + 0.5 * (((r - mu[0]) / sd[0]) ** 2 - ((r - mu[1]) / sd[1]) ** 2)
    out, p = np.empty(r.size), start
    for i, e in enumerate(edge.tolist()):
        up = p * stay[0] + (1 - p) * (1 - stay[1]) if i else p
        p = 1 / (1 + math.exp(min(max(e + math.log(max(1 - up, 1e-300) / max(up, 1e-300)), -700), 700)))
        out[i] = p
    return out


def kalman_z(close, high, low, w=60, cr=0.1, cb=0.01, k=5) -> np.ndarray:
    """Local linear trend on the log close: the forecast k bars on, over its deviation.

    The state begins at the first close with the identity as covariance and steps with the first bar at once; the noise
    is the rolling mean of the range variance, of bars without a range 0.
    """
    y, out = np.log(close), np.full(close.size, NAN)
    var = np.where((high > 0) & (low > 0), np.log(np.maximum(high, 1e-300) / np.maximum(low, 1e-300)) ** 2 / (4 * math.log(2)), 0.0)
    total = np.concatenate([[0.0], np.cumsum(var)])
    level, slope, a, b, c = (y[0] if y.size else 0.0), 0.0, 1.0, 0.0, 1.0
    for t, x in enumerate(y.tolist()):
        m = (total[t + 1] - total[max(0, t + 1 - w)]) / min(t + 1, w)
        noise, drift = cr * m, cb * m
        level, a, b, c = level + slope, a + 2 * b + c, b + c, c + drift
        s = a + noise
        if s > 1e-18:
            g, h, gap = a / s, b / s, x - level
            level, slope = level + g * gap, slope + h * gap
            # Joseph form of the update
            a, b, c = (1 - g) ** 2 * a + g * g * noise, (1 - g) * (b - h * a) + g * h * noise, c - 2 * h * b + h * h * a + h * h * noise
        if t >= w - 1:
            far = a + 2 * k * b + k * k * c + drift * (k - 1) * k * (2 * k - 1) / 6 + noise
            out[t] = min(max((level + k * slope - x) / math.sqrt(far), -50), 50) if far > 1e-18 else 0.0
    return out


def spectrum(x: np.ndarray) -> np.ndarray:
    """Power of the bins 1..N/2 of centred windows (adopted)."""
    return np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)[:, 1:]) ** 2


def acf(x: np.ndarray, most: int) -> np.ndarray:
    """Biased autocorrelation of windows at the lags 0..most."""
    c = x - x.mean(1, keepdims=True)
    base = np.maximum((c * c).sum(1), 1e-300)
    return np.stack([(c[:, k:] * c[:, : c.shape[1] - k]).sum(1) / base for k in range(most + 1)], axis=1)


def spectral(r: np.ndarray, w=64, k=4, low=4, high=(5, 20), floor=0.1) -> dict:
    x = windows(r, w)
    p, a = spectrum(x), acf(x, high[1])
    total, bins = np.maximum(p.sum(1), 1e-300), np.arange(1, p.shape[1] + 1)
    lk = np.log(bins) - np.log(bins).mean()
    inner = a[:, 1:-1]
    peaks = (inner >= floor) & (inner > a[:, :-2]) & (inner >= a[:, 2:])
    return {
        "ret_spec_lowfreq_ratio": p[:, :k].sum(1) / total,
        "ret_spec_centroid": (p * bins).sum(1) / total / w,
        "ret_spec_slope": (np.log(np.maximum(p, 1e-300)) * lk).sum(1) / (lk * lk).sum(),
        "ret_ac_low_energy": (a[:, 1 : low + 1] ** 2).sum(1),
        "ret_ac_high_energy": (a[:, high[0] : high[1] + 1] ** 2).sum(1),
        "ret_ac_peak_count": peaks.sum(1).astype(float),
    }


def low_freq_return(r: np.ndarray, n=64, k=3, m=10) -> np.ndarray:
    x = windows(r, n)
    p = spectrum(x)
    return p[:, :k].sum(1) / np.maximum(p.sum(1), 1e-300) * x[:, -m:].mean(1)


def zero_cross(close: np.ndarray, w=40) -> np.ndarray:
    """Share of sign changes of the deviation from the window mean; zeros keep the sign before (adopted)."""
    x = windows(close, w)
    s = np.sign(x - x.mean(1, keepdims=True))
    for j in range(1, w):
        s[:, j] = np.where(s[:, j] == 0, s[:, j - 1], s[:, j])
    return ((s[:, 1:] * s[:, :-1]) < 0).sum(1) / (w - 1)


def high_remaining(volume: np.ndarray, w=240, q=0.8, history=480, longest=60) -> np.ndarray:
    """Expected bars that a high-volume run still lasts at its age, from completed runs (adopted)."""
    out, age, runs = np.full(volume.size, NAN), 0, []
    x = windows(volume, w)
    limit = np.quantile(x, q, axis=1) if len(x) else np.empty(0)
    for i, t in enumerate(range(w - 1, volume.size)):
        if volume[t] > limit[i]:
            age += 1
            own = [n - age for end, n in runs if end > t - history and n >= age]
            out[t] = sum(own) / len(own) if own else 0.0
        else:
            if age:
                runs.append((t - 1, min(age, longest)))
            age, out[t] = 0, 0.0
    return out


def first_loading(r, lv, amp, w=40) -> np.ndarray:
    """Return loading of the first eigenvector; its largest entry is made positive."""
    x = np.stack([windows(v, w) for v in (r, lv, amp)], axis=1)
    if not len(x):
        return np.empty(0)
    c = x - x.mean(2, keepdims=True)
    vec = np.linalg.eigh(c @ c.transpose(0, 2, 1) / (w - 1))[1][:, :, -1]
    sign = np.sign(np.take_along_axis(vec, np.abs(vec).argmax(1)[:, None], 1))
    return vec[:, 0] * sign[:, 0]


def oja(x: np.ndarray, k: int, rate=0.05, warmup=64):
    """Oja/Sanger components after every sample from `warmup` on (adopted: centred on the running mean)."""
    d = x.shape[1]
    w, mean = np.eye(d)[:k].copy(), np.zeros(d)
    for t in range(len(x)):
        mean += (x[t] - mean) / (t + 1)
        c = x[t] - mean
        norm = np.linalg.norm(c)
        if norm > 0:
            c = c / max(norm, 1.0)
            y = w @ c
            for j in range(k):
                w[j] += rate * y[j] * (c - y[: j + 1] @ w[: j + 1])
                w[j] /= max(np.linalg.norm(w[j]), 1e-12)
        yield t, w


def pca_factors(r, close, volume, turnover, rate=0.05, warmup=64) -> tuple[np.ndarray, np.ndarray]:
    """Angular momentum in the plane of the first two components; steadiness of the first."""
    traded = (volume > 0) & (turnover > 0)
    vwap = np.where(traded, turnover / np.where(traded, volume, 1), close)
    x = np.column_stack([r, np.log1p(volume), np.log(vwap)])
    momentum, steady = np.full(len(x), NAN), np.full(len(x), NAN)
    uv = first = None
    for t, w in oja(x, 2, rate, warmup):
        if t >= warmup - 1:
            now = w @ x[t]
            if uv is not None:
                momentum[t] = abs(uv[0] * now[1] - uv[1] * now[0])
                steady[t] = abs(w[0] @ first) / max(np.linalg.norm(w[0]) * np.linalg.norm(first), 1e-12)
            uv, first = now, w[0].copy()
    return momentum, steady


def symbolic(r: np.ndarray, w=256, k=6, edge=0.1) -> np.ndarray:
    """Leading eigenvalue of the window's first-order transition matrix over equal bins."""
    if r.size < w:
        return np.empty(0)
    s = np.clip(((r + edge) / (2 * edge / k)).astype(int), 0, k - 1)
    seen = np.zeros((r.size, k * k))
    seen[np.arange(1, r.size), s[:-1] * k + s[1:]] = 1
    total = np.cumsum(seen, axis=0)
    m = (total[w - 1 :] - total[: r.size - w + 1]).reshape(-1, k, k)  # the window's first row closes no transition of it
    return np.abs(np.linalg.eigvals(m / np.maximum(m.sum(2, keepdims=True), 1))).max(1)


def memory_kernel(r: np.ndarray, w=128, lags=50, alpha=0.6) -> np.ndarray:
    """Autocorrelations weighed by fractional-difference weights that add up to 1 (adopted)."""
    k = np.arange(1, lags + 1)
    weight = np.abs(np.cumprod((k - 1 - alpha) / k))
    return acf(windows(r, w), lags)[:, 1:] @ (weight / weight.sum())


# fixed values: the eight-tap Daubechies scaling filter
DB4 = np.array([0.2303778133088964, 0.7148465705529154, 0.6308807679298587, -0.0279837694168599, -0.1870348117190931, 0.0308413818355607, 0.0328830116668852, -0.0105974017850690])


def wavelet_energy(price: np.ndarray, w=128, levels=6, from_level=4) -> np.ndarray:
    """Share of the coarse levels in the detail energy of log returns, signed by the window's move."""
    g, h = DB4 / math.sqrt(2), DB4[::-1] * (-1.0) ** np.arange(8) / math.sqrt(2)
    lp = np.log(price)
    smooth, energy = np.diff(lp), []
    for j in range(levels):
        taps = np.arange(8) * 2**j
        pad = np.concatenate([np.zeros(taps[-1]), smooth])
        shifted = np.stack([pad[taps[-1] - t : taps[-1] - t + smooth.size] for t in taps])
        energy.append(np.cumsum(np.concatenate([[0.0], (h @ shifted) ** 2])))
        smooth = g @ shifted
    out = np.full(price.size, NAN)
    e = np.array([c[w:] - c[:-w] for c in energy]) if price.size > w else np.empty((levels, 0))
    total = e.sum(0)
    move = lp[w:] - lp[: max(0, lp.size - w)]
    last = np.maximum.accumulate(np.where(np.abs(move) > 1e-12, np.arange(move.size), -1))  # a still window keeps the sign before
    sign = np.where(last >= 0, np.sign(move[np.maximum(last, 0)]), 1.0) if move.size else move
    out[w:] = np.where(total > 0, sign * np.clip(e[from_level - 1 :].sum(0) / np.where(total > 0, total, 1), 0, 1), 1.0)
    return out


def haar_trend(close: np.ndarray, w=32, levels=2) -> np.ndarray:
    """Share of the approximation in the centred Haar energy times the sign of the window's move."""
    x = np.log(windows(close, w))
    a = x - x.mean(1, keepdims=True)
    total = np.maximum((a * a).sum(1), 1e-300)
    for _ in range(levels):
        a = (a[:, ::2] + a[:, 1::2]) / math.sqrt(2)
    return (a * a).sum(1) / total * np.sign(x[:, -1] - x[:, 0])


def ssa(close: np.ndarray, n=40, lag=10, rank=2, tail=5) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the last points of the rank-r reconstruction, and the rank's energy share."""
    x = np.log(windows(close, n))
    if not len(x):
        return np.empty(0), np.empty(0)
    wide = n - lag + 1
    u, s, v = np.linalg.svd(np.lib.stride_tricks.sliding_window_view(x, wide, axis=1), full_matrices=False)
    low = (u[:, :, :rank] * s[:, None, :rank]) @ v[:, :rank]
    line = np.stack([np.mean([low[:, i, p - i] for i in range(max(0, p - wide + 1), min(lag, p + 1))], axis=0) for p in range(n - tail, n)], axis=1)
    t = np.arange(tail) - (tail - 1) / 2
    return line @ t / (t * t).sum(), (s[:, :rank] ** 2).sum(1) / np.maximum((s**2).sum(1), 1e-300)


def dmd_growth(close: np.ndarray, w=40, m=4, rank=2) -> np.ndarray:
    """Growth rate of the leading mode of delay-embedded log closes."""
    x = np.log(windows(close, w))
    if not len(x):
        return np.empty(0)
    h = np.lib.stride_tricks.sliding_window_view(x, w - m + 1, axis=1)
    u, s, v = np.linalg.svd(h[:, :, :-1], full_matrices=False)
    u, s, v = u[:, :, :rank], np.maximum(s[:, :rank], 1e-12), v[:, :rank]
    lead = np.linalg.eigvals(u.transpose(0, 2, 1) @ h[:, :, 1:] @ v.transpose(0, 2, 1) / s[:, None, :])
    return np.log(np.maximum(np.abs(lead).max(1), 1e-300))


def bma_drift(r: np.ndarray, w=40, alpha=0.1) -> np.ndarray:
    """Drift averaged over the mean, an exponential mean and a line's end by their evidence (adopted)."""
    x = windows(r, w)
    if not len(x):
        return np.empty(0)
    t = np.arange(w) - (w - 1) / 2
    decay = alpha * (1 - alpha) ** np.arange(w)[::-1]
    mean = x.mean(1)
    slope = (x * t).sum(1) / (t * t).sum()
    fits = [np.repeat(mean[:, None], w, 1), np.repeat((x @ (decay / decay.sum()))[:, None], w, 1), mean[:, None] + slope[:, None] * t]
    drift = np.stack([fits[0][:, -1], fits[1][:, -1], fits[2][:, -1]], axis=1)
    sse = np.stack([((x - f) ** 2).mean(1) for f in fits], axis=1)
    score = -0.5 * w * np.log(np.maximum(sse, 1e-300)) - 0.5 * np.array([1, 1, 2]) * math.log(w)
    weight = np.exp(score - score.max(1, keepdims=True))
    return (weight * drift).sum(1) / weight.sum(1)


def f_survival(f: float, a: int, b: int) -> float:
    """Upper tail of the F distribution by the continued fraction of the incomplete beta function."""
    if not f > 0:
        return 1.0
    x, p, q = b / (b + a * f), b / 2, a / 2
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) if x < 1 else 0.0
    if x > (p + 1) / (p + q + 2):
        return 1 - front * _fraction(1 - x, q, p) / q
    return front * _fraction(x, p, q) / p


def _fraction(x: float, a: float, b: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def granger(y: np.ndarray, x: np.ndarray, w=240, p=2, q=2, least=16, cap=20.0) -> tuple[np.ndarray, np.ndarray]:
    """Strength and p-value of x's lags for y in rolling least squares; n counts y's window.

    The normal equations of all windows are solved side by side; rows before the first full set of lags weigh nothing.
    """
    strength, pval, top = np.full(y.size, NAN), np.full(y.size, NAN), max(p, q)
    if y.size <= top:
        return strength, pval
    lag = lambda v, k: np.concatenate([np.zeros(k), v[: v.size - k]])
    rows = np.column_stack([np.ones(y.size), *(lag(y, k) for k in range(1, p + 1)), *(lag(x, k) for k in range(1, q + 1)), y])
    rows[:top] = 0
    padded = np.concatenate([np.zeros((w - 1, rows.shape[1])), rows])
    for lo in range(0, y.size, 2048):
        own = np.lib.stride_tricks.sliding_window_view(padded[lo : lo + 2048 + w - 1], w, axis=0)[: y.size - lo]
        gram = own @ own.transpose(0, 2, 1)
        rss = [_residual(gram, m) for m in (p + 1, p + q + 1)]
        for t in range(lo, lo + len(own)):
            n = min(t + 1, w)
            df, one, two = n - (p + q + 1), rss[0][t - lo], rss[1][t - lo]
            if n < max(least, p + q + 4) or df <= 0 or t + 1 - max(top, t + 1 - w) < p + q + 2 or not math.isfinite(one + two):
                continue
            den = two / df
            f = max(one - two, 0.0) / max(1, q) / (den if den > 0 else 1e-18)
            pval[t] = min(max(f_survival(f, q, df), 0.0), 1.0) if math.isfinite(f) else 0.0
            strength[t] = min(-math.log10(max(pval[t], 2.2250738585072014e-308)), cap)
    return strength, pval


def _residual(gram: np.ndarray, m: int) -> np.ndarray:
    """Residual sums of the last column on the first m of Gram matrices; NaN where these depend on one another."""
    scale = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 1e-300))
    unit = gram / scale[:, :, None] / scale[:, None, :]
    a, b, out = unit[:, :m, :m], unit[:, :m, -1], np.full(len(gram), NAN)
    ok = np.linalg.eigvalsh(a)[:, 0] > 1e-10
    if ok.any():
        out[ok] = np.maximum(gram[ok, -1, -1] * (1 - (b[ok] * np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]).sum(1)), 0)
    return out


def copula(ofi, volume, r, w=30, reg=1e-6) -> np.ndarray:
    """Conditional mean of the return score given order-flow scores, as a return of the window."""
    from statistics import NormalDist

    out = np.full(r.size, NAN)
    if r.size < 2 * w - 1:
        return out
    cells = np.array([NormalDist().inv_cdf(min(max(k / (2 * w), 1e-6), 1 - 1e-6)) for k in range(2 * w + 1)])
    x = [windows(np.asarray(v, float), w) for v in (ofi, volume, r)]
    z = np.column_stack([cells[2 * (v < v[:, -1:]).sum(1) + (v == v[:, -1:]).sum(1)] for v in x])
    own = np.lib.stride_tricks.sliding_window_view(z, w, axis=0)
    mu = own.mean(2)
    c = own - mu[:, :, None]
    cov = c @ c.transpose(0, 2, 1) / (w - 1) + reg * np.eye(3)
    weight = np.linalg.solve(cov[:, :2, :2], (z[w - 1 :, :2] - mu[:, :2])[:, :, None])[:, :, 0]
    at = _phi(mu[:, 2] + (cov[:, 2, :2] * weight).sum(1)) * (w - 1)
    ordered, lo = np.sort(x[2][w - 1 :], axis=1), np.minimum(np.floor(at).astype(int), w - 2)
    pick = lambda i: np.take_along_axis(ordered, i[:, None], 1)[:, 0]
    out[2 * w - 2 :] = pick(lo) + (at - lo) * (pick(lo + 1) - pick(lo))
    return out
