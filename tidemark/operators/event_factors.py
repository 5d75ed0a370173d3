"""Factors over the union of event sources, several windows at once, the calendar and full-sample ranks, as SQL.

A price event is a quote's mid where both sides are positive, or the price of a trade or an order; a volume event is a
quote's volume as it stands (cumulative), or that of a trade or an order.  A code's events are
numbered by arrival, and the factor texts read that number in place of the time.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.calendar import in_auction, in_session, is_weekday, next_session
from ..functions.mathx import clamp, normal_ppf
from .sql_factors import RETURNS, ls_info_gain, prob_momentum, rows, volume_autocorr, volume_mgf

_ARRIVAL = "row_number() OVER (PARTITION BY code ORDER BY ts_ms, src, seq) AS arrival"
PRICES = f"""SELECT code, {_ARRIVAL}, close, volume FROM (
  SELECT code, ts_ms, seq, 0 AS src, (bid + ask) / 2e0 AS close, 0 AS volume FROM {{quotes}} WHERE bid > 0 AND ask > 0
  UNION ALL SELECT code, ts_ms, seq, 1, price, volume FROM {{trades}} UNION ALL SELECT code, ts_ms, seq, 2, price, volume FROM {{orders}}) WHERE close > 0"""
#: Mids as they are and trades: what the symbolic dynamics read.
MIDS_AND_TRADES = f"""SELECT code, {_ARRIVAL}, close FROM (
  SELECT code, ts_ms, seq, 0 AS src, (bid + ask) / 2e0 AS close FROM {{quotes}} UNION ALL SELECT code, ts_ms, seq, 1, price FROM {{trades}}) WHERE close > 0"""
VOLUMES = f"""SELECT code, {_ARRIVAL}, CAST(volume AS DOUBLE) AS volume FROM (
  SELECT code, ts_ms, seq, 0 AS src, volume FROM {{quotes}} UNION ALL SELECT code, ts_ms, seq, 1, volume FROM {{trades}} UNION ALL SELECT code, ts_ms, seq, 2, volume FROM {{orders}})"""


def over(text: str, events: str) -> str:
    """A bar factor's text over events in order of arrival."""
    return text.replace("ts_ms", "arrival").replace("{bars}", f"({events})")


def windows(factor: Callable[[int], str], sizes: list[int], most: int = 500) -> str:
    """A factor for up to eight distinct window sizes, each in 1..most, with the size in `win`."""
    own = sorted({min(max(s, 1), most) for s in sizes})
    if len(own) > 8:
        raise ValueError("at most eight windows")
    return " UNION ALL ".join(f"SELECT CAST({w} AS BIGINT) AS win, * FROM ({factor(w)})" for w in own)


def volume_mean(w: int) -> str:
    """Mean and deviation of the volume over full windows."""
    return f"SELECT code, ts_ms, round(m, 6) AS volume_mean, round(s, 6) AS volume_sd FROM (SELECT code, ts_ms, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS s, count(*) OVER w AS n FROM {{bars}} WHERE volume > 0 WINDOW {rows(w)}) WHERE n = {w}"


def calendar() -> str:
    """Sessions of every quote's time."""
    flag = lambda e: f"CASE WHEN {e('ts_ms')} THEN 1 ELSE 0 END"
    return f"SELECT code, ts_ms, seq, {flag(in_session)} AS in_session, {flag(in_auction)} AS in_auction, {flag(is_weekday)} AS is_weekday, CAST({next_session('ts_ms')} AS BIGINT) AS next_session_ms FROM {{quotes}}"


def rank_normal() -> str:
    """Every return's mid-rank in its code's whole sample, as a normal score; ties share one."""
    return f"""SELECT code, ts_ms, round({normal_ppf("u")}, 6) AS z FROM (
  SELECT code, ts_ms, {clamp("(a + (c - 1) / 2e0 - 5e-1) / n", 0.000001, 0.999999)} AS u FROM (
    SELECT code, ts_ms, rank() OVER (PARTITION BY code ORDER BY r) AS a, count(*) OVER (PARTITION BY code, r) AS c, count(*) OVER (PARTITION BY code) AS n FROM {RETURNS} WHERE r IS NOT NULL))""".replace("1e-06e0", "1e-6")


def cropped(bars: int = 250, first_ms: int = 0, last_ms: int = 1 << 60) -> str:
    """The last bars of every code within a range of times, both ends included."""
    return f"SELECT code, ts_ms, close, CAST(volume AS DOUBLE) AS volume FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts_ms DESC) AS k FROM {{bars}} WHERE ts_ms BETWEEN {first_ms} AND {last_ms}) WHERE k <= {bars}"


FACTORS = {
    "event_prob_momentum": over(prob_momentum(), PRICES), "event_ls_info_gain": over(ls_info_gain(), PRICES), "event_volume_mgf": over(volume_mgf(t=1e-5), VOLUMES), "event_volume_autocorr": over(volume_autocorr(), VOLUMES),
    "volume_windows": windows(volume_mean, [20, 60, 0, 60, 240]), "session_flags": calendar(), "rank_normal": rank_normal(), "last_bars": cropped(),
}
