"""Streaming twins: keyed state in the state store, the same definitions as in batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kernels as k

OUT = "code string, ts_ms long, topic string, value double"


def _hawkes(mu: float, alpha: float, beta: float, dt: float):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        level, last = state.get if state.exists else (mu, -(1 << 62))
        keep, rows = math.exp(-beta * dt), []
        for pdf in batches:
            for ts, kind in pdf.sort_values(["ts_ms", "seq"])[["ts_ms", "kind"]].itertuples(index=False):
                if ts < last:
                    continue  # late events are dropped, equal times are kept
                level, last = mu + keep * (level - mu) + alpha * (kind == "Trade"), ts
                rows.append((key[0], ts, "time/hawkes_intensity", level))
        state.update((level, int(last)))
        yield pd.DataFrame(rows, columns=["code", "ts_ms", "topic", "value"])

    return step


def hawkes(ticks: DataFrame, mu: float = 0.1, alpha: float = 0.3, beta: float = 1.2, dt: float = 1.0) -> DataFrame:
    """ticks: (code, ts_ms, seq, kind), streaming."""
    return ticks.groupBy("code").applyInPandasWithState(_hawkes(mu, alpha, beta, dt), OUT, "level double, last long", "append", GroupStateTimeout.NoTimeout)


def _gaussian(window: int):
    from statistics import NormalDist

    quantile = NormalDist().inv_cdf

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        own = list(state.get[0]) if state.exists else []
        rows = []
        for pdf in batches:
            for ts, x in pdf.sort_values(["ts_ms", "seq"])[["ts_ms", "value"]].itertuples(index=False):
                if not math.isfinite(x):
                    continue
                own = [*own[-(window - 1) :], float(x)] if window > 1 else [float(x)]
                u = (sum(v <= x for v in own) - 0.5) / len(own)
                rows.append((key[0], ts, "gaussian_rank", quantile(min(max(u, 1e-6), 1 - 1e-6))))
        state.update((own,))
        yield pd.DataFrame(rows, columns=["code", "ts_ms", "topic", "value"])

    return step


def gaussian_rank(values: DataFrame, window: int = 250) -> DataFrame:
    """Rolling normal scores of a live factor: (code, ts_ms, seq, value) in, the derived topic out."""
    return values.groupBy("code").applyInPandasWithState(_gaussian(window), OUT, "own array<double>", "append", GroupStateTimeout.NoTimeout)


def time_buckets(trades: DataFrame, size: str = "1 second", delay: str = "5 seconds") -> DataFrame:
    """Bucket sums of live trades (code, ts timestamp, price, volume) behind a watermark, stamped with the bucket's end."""
    w = F.window("ts", size)
    out = trades.withWatermark("ts", delay).groupBy("code", w).agg(F.sum(F.col("price") * F.col("volume")).alias("amount"), F.sum("volume").alias("volume"), F.count("*").alias("n"))
    return out.select("code", F.unix_millis("window.end").alias("bucket_end_ms"), "amount", "volume", "n")


def batch_hawkes(ticks: DataFrame) -> DataFrame:
    """The batch twin of hawkes(), for checks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "seq"])
        return pd.DataFrame({"code": pdf.code, "ts_ms": pdf.ts_ms, "topic": "time/hawkes_intensity", "value": k.hawkes((pdf.kind == "Trade").to_numpy(float))})

    return ticks.groupBy("code").applyInPandas(run, OUT)
