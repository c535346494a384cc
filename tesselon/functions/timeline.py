"""Points in time: ISO parsing, periods and lists of instants, all in UTC."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime, timedelta

# fixed values: the accepted layouts by length
LAYOUTS = {4: "%Y", 6: "%Y%m", 7: "%Y-%m", 8: "%Y%m%d", 10: "%Y-%m-%d", 13: "%Y-%m-%dT%H", 16: "%Y-%m-%dT%H:%M", 19: "%Y-%m-%dT%H:%M:%S", 23: "%Y-%m-%dT%H:%M:%S.%f"}
# fixed values: named intervals
INTERVALS = {"yearly": "P1Y", "quarterly": "P3M", "monthly": "P1M", "weekly": "P7D", "daily": "P1D", "hourly": "PT1H"}
PERIOD = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")


def parse_iso(text: str) -> datetime:
    """An instant (without zone, meaning UTC); other zones and negative years are refused."""
    bare = text[:-1] if text.endswith("Z") else text
    if len(bare) == 5 and bare[2] == ":":
        raise ValueError(f"a date is needed: {text}")
    layout = LAYOUTS.get(len(bare))
    if layout is None or not re.fullmatch(r"[0-9T:.-]+", bare):
        raise ValueError(f"not an ISO date-time in UTC: {text}")
    try:
        return datetime.strptime(bare, layout)
    except ValueError as e:
        raise ValueError(f"not an ISO date-time in UTC: {text}") from e


def parse_period(text: str) -> tuple[int, timedelta]:
    """Months and the rest of an ISO period such as P1Y2M or PT6H; one of no length is refused."""
    m = PERIOD.fullmatch(INTERVALS.get(text.lower(), text))
    if not m or text.endswith(("P", "T")):
        raise ValueError(f"not an ISO period: {text}")
    years, months, weeks, days, hours, minutes, seconds = (int(x or 0) for x in m.groups())
    out = 12 * years + months, timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds)
    if not out[0] and not out[1]:
        raise ValueError(f"a period of no length: {text}")
    return out


def shift(t: datetime, months: int, rest: timedelta, n: int) -> datetime:
    """t + n times the period, from t itself: no drift over short months."""
    years, month = divmod(t.month - 1 + n * months, 12)
    year = t.year + years
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1])) + n * rest


def as_instant(t: str | datetime) -> datetime:
    if isinstance(t, str):
        return parse_iso(t)
    return t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t


def instants(start, end=None, period: str | None = None, *more, from_end: bool = False) -> list[datetime]:
    """One instant, two or more (sorted, without repeats), or start, start + period, ... up to end (backwards from end, if so wanted)."""
    first = as_instant(start)
    if period is None or not isinstance(period, str) or not period.upper().startswith("P") and period.lower() not in INTERVALS:
        return sorted({first, *(as_instant(t) for t in (end, period, *more) if t is not None)})
    last = as_instant(end)
    if first > last:
        raise ValueError("the start lies after the end")
    months, rest = parse_period(period)
    out, n = [], 0
    while True:
        t = shift(last, months, rest, -n) if from_end else shift(first, months, rest, n)
        if t < first or t > last:
            return out[::-1] if from_end else out
        out.append(t)
        n += 1


def default_instants() -> list[datetime]:
    """Monthly from 2008 until today."""
    return instants("2008-01-01", datetime.now(UTC).strftime("%Y-%m-%d"), "P1M")
