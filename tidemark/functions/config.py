"""INI configuration, window lists and duration tokens."""

from __future__ import annotations

import configparser
import re

MAX_WINDOWS, MAX_WINDOW = 8, 500
# fixed values: milliseconds of the duration units
UNITS = {"ms": 1, "s": 1000, "sec": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "day": 86_400_000, "w": 604_800_000, "month": 2_592_000_000, "y": 31_536_000_000, "year": 31_536_000_000, "毫秒": 1, "秒": 1000, "分": 60_000, "分钟": 60_000, "小时": 3_600_000, "时": 3_600_000, "天": 86_400_000, "日": 86_400_000, "周": 604_800_000, "月": 2_592_000_000, "年": 31_536_000_000}
LONGEST = 10 * UNITS["year"]


def read_ini(text: str) -> dict[str, str]:
    """Flattened section.key -> value; # and ; begin comments."""
    parser = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), interpolation=None, strict=False)
    parser.optionxform = str
    parser.read_string(text)
    return {f"{s}.{k}": v.strip() for s in parser.sections() for k, v in parser.items(s)}


def truthy(value: str) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on")


def windows(text: str) -> list[int]:
    """Positive window sizes, sorted and distinct, at most MAX_WINDOWS of at most MAX_WINDOW."""
    sizes = sorted({min(int(x), MAX_WINDOW) for x in re.split(r"[,\s]+", text) if re.fullmatch(r"\d+", x) and int(x) > 0})
    return sizes[:MAX_WINDOWS]


def duration_ms(token: str) -> int:
    """Milliseconds of a token such as 500ms, 5min or 1天; bare numbers are milliseconds."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(\D*?)\s*", token)
    unit = m and (m[2].lower() or "ms")
    unit = unit if unit in UNITS else (unit or "").rstrip("s") or "s"
    if not m or unit not in UNITS:
        raise ValueError(f"not a duration: {token!r}")
    return int(min(max(float(m[1]) * UNITS[unit], 1), LONGEST))
