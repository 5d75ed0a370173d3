"""Trading calendar on millisecond stamps read as local time of day."""

from __future__ import annotations

DAY, HOUR, MINUTE = 86_400_000, 3_600_000, 60_000
# fixed values: sessions of the exchange, [from, to) in minutes of the day
CONTINUOUS = [(9 * 60 + 30, 11 * 60 + 30), (13 * 60, 15 * 60)]
AUCTION = [(9 * 60 + 15, 9 * 60 + 25), (14 * 60 + 57, 15 * 60)]


def _within(ts: str, spans) -> str:
    of_day = f"({ts} % {DAY})"
    return "(" + " OR ".join(f"({of_day} >= {a * MINUTE} AND {of_day} < {b * MINUTE})" for a, b in spans) + ")"


def in_session(ts: str) -> str:
    """SQL: within continuous trading."""
    return _within(ts, CONTINUOUS)


def in_auction(ts: str) -> str:
    """SQL: within a call auction."""
    return _within(ts, AUCTION)


def next_session(ts: str) -> str:
    """SQL: the next session start: 09:30, then 13:00, else 09:30 of the next day."""
    day, of_day = f"({ts} - {ts} % {DAY})", f"({ts} % {DAY})"
    first, second = CONTINUOUS[0][0] * MINUTE, CONTINUOUS[1][0] * MINUTE
    return f"(CASE WHEN {of_day} < {first} THEN {day} + {first} WHEN {of_day} < {second} THEN {day} + {second} ELSE {day} + {DAY + first} END)"


def is_weekday(ts: str) -> str:
    """SQL: neither Saturday nor Sunday (day 0 was a Thursday)."""
    return f"(((({ts} - {ts} % {DAY}) / {DAY}) + 3) % 7 < 5)"
