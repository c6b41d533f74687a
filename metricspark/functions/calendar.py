"""Calendar labels on the wall clock of a zone, as columns and for spans of windows on the driver."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Ceilings of one request: buckets, days that they reach back, windows.
MOST_BUCKETS, MOST_DAYS, MOST_WINDOWS = 3660, 3660, 366
#: Buckets that a value may be carried over for one subject.
MOST_CARRIED = 3660
WIDTH_DAYS = {"minute": 1 / 1440, "15 minutes": 1 / 96, "hour": 1 / 24, "day": 1, "week": 7, "month": 31, "quarter": 92}
DEFAULT_WINDOWS = ("30", "14", "7")


@lru_cache(maxsize=1)
def zones() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones())


def usable(zone: Column) -> Column:
    """The zone where it is one, else null, so that no conversion fails."""
    return F.when(zone.isin(*sorted(zones())), zone)


def local(ts: Column, zone: Column | str | None) -> Column:
    """The wall clock of a zone; without one UTC."""
    if zone is None or (isinstance(zone, str) and zone in ("UTC", "Etc/UTC")):
        return ts
    return F.from_utc_timestamp(ts, zone if isinstance(zone, Column) else F.lit(zone))


def label(wall: Column, grain: str) -> Column:
    """The label of the bucket that a wall-clock time lies in."""
    if grain == "minute":
        return F.date_format(wall, "yyyy-MM-dd'T'HH:mm")
    if grain == "15 minutes":
        return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:"), F.lpad((F.floor(F.minute(wall) / 15) * 15).cast("string"), 2, "0"))
    if grain == "hour":
        return F.date_format(wall, "yyyy-MM-dd'T'HH:00")
    if grain == "day":
        return F.date_format(wall, "yyyy-MM-dd")
    if grain == "week":
        return F.format_string("%04d-W%02d", F.expr("0") + F.extract(F.lit("YEAROFWEEK"), wall), F.extract(F.lit("WEEK"), wall))
    if grain == "month":
        return F.date_format(wall, "yyyy-MM")
    if grain == "quarter":
        return F.format_string("%04d-Q%d", F.year(wall), F.quarter(wall))
    raise ValueError(grain)


def ordinal_label(wall: Column, nth: int, weekday: int) -> Column:
    """The day's label if it is the nth such weekday of its month, else null."""
    day = F.to_date(wall)
    return F.when((F.weekday(day) == weekday) & (F.ceil(F.dayofmonth(day) / 7) == nth), F.date_format(wall, "yyyy-MM-dd"))


_TRUNC = {"day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER"}
_STEP = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months"}


def span_labels(start: Column, end: Column, grain: str) -> Column:
    """array<string> of the labels from one wall-clock time until another, both included; none if an end lacks or they are reversed."""
    a, b = F.to_date(F.date_trunc(_TRUNC[grain], start)), F.to_date(F.date_trunc(_TRUNC[grain], end))
    dates = F.when((end >= start) & (b >= a), F.sequence(a, b, F.expr(_STEP[grain])))
    return F.transform(F.coalesce(dates, F.array().cast("array<date>")), lambda d: label(d.cast("timestamp"), grain))


# --- on the driver ---------------------------------------------------------------------------------------------


def _start(t: dt.datetime, grain: str) -> dt.datetime:
    t = t.replace(second=0, microsecond=0)
    if grain == "minute":
        return t
    if grain == "15 minutes":
        return t.replace(minute=t.minute // 15 * 15)
    t = t.replace(minute=0)
    if grain == "hour":
        return t
    t = t.replace(hour=0)
    if grain == "day":
        return t
    if grain == "week":
        return t - dt.timedelta(days=t.weekday())
    t = t.replace(day=1)
    return t if grain == "month" else t.replace(month=(t.month - 1) // 3 * 3 + 1)


def back(t: dt.datetime, grain: str, n: int) -> dt.datetime:
    """The start of the bucket n before that of t, in wall-clock steps."""
    t = _start(t, grain)
    if grain in ("month", "quarter"):
        months = t.year * 12 + t.month - 1 - n * (3 if grain == "quarter" else 1)
        return t.replace(year=months // 12, month=months % 12 + 1)
    return t - n * {"minute": dt.timedelta(minutes=1), "15 minutes": dt.timedelta(minutes=15), "hour": dt.timedelta(hours=1), "day": dt.timedelta(days=1), "week": dt.timedelta(days=7)}[grain]


def name_of(t: dt.datetime, grain: str) -> str:
    if grain in ("minute", "15 minutes", "hour"):
        return f"{t.year:04d}-{_start(t, grain):%m-%dT%H:%M}"
    if grain == "day":
        return f"{t.year:04d}-{t:%m-%d}"
    if grain == "week":
        y, w, _ = t.isocalendar()
        return f"{y:04d}-W{w:02d}"
    return f"{t.year:04d}-{t:%m}" if grain == "month" else f"{t.year:04d}-Q{(t.month + 2) // 3}"


def wall(at: dt.datetime, zone: str | None) -> dt.datetime:
    return at.replace(tzinfo=dt.timezone.utc).astimezone(zoneinfo.ZoneInfo(zone or "UTC")).replace(tzinfo=None)


class WindowError(ValueError):
    """A window that is refused."""


def parse_span(spec: str) -> tuple[int, int]:
    """(nearest, farthest) bucket of a window `N` or `a-b`, counted back from the anchor's bucket, which is 1."""
    ends = spec.split("-")
    if not all(e.isascii() and e.isdigit() and len(e) <= 9 and int(e) >= 1 for e in ends) or len(ends) > 2:
        raise WindowError(f"{spec!r} is no window")
    a, b = (1, int(ends[0])) if len(ends) == 1 else (int(ends[0]), int(ends[1]))
    if a > b:
        raise WindowError(f"{spec!r} runs backwards")
    return a, b


def expand(specs: list[str], grain: str) -> list[str]:
    """The windows of a request, `each:` ones as one-bucket windows, within the ceilings."""
    out: list[str] = []
    reach = lambda b: b * WIDTH_DAYS[grain]
    for spec in specs:
        each = spec.startswith("each:")
        a, b = parse_span(spec.removeprefix("each:"))
        if b - a + 1 > MOST_BUCKETS or reach(b) > MOST_DAYS + WIDTH_DAYS[grain]:
            raise WindowError(f"{spec!r} reaches too far")
        if each and len(out) + b - a + 1 > MOST_WINDOWS:
            raise WindowError("too many windows")
        out += [f"{i}-{i}" for i in range(a, b + 1)] if each else [spec]
    canonical = [parse_span(s) for s in out]
    if len(out) > MOST_WINDOWS:
        raise WindowError("too many windows")
    if len({*canonical}) < len(canonical):
        raise WindowError("a window is asked for twice")
    return out


def window_labels(at: dt.datetime, zone: str | None, spec: str, grain: str | None, ordinal: tuple[int, int] | None = None) -> list[str]:
    """The labels of a window, oldest first; buckets before the calendar's start are left out."""
    a, b = parse_span(spec)
    now = wall(at, zone)
    if ordinal:
        found: list[str] = []
        first = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        while len(found) < b and (first.year, first.month) > (1, 1):
            day = first + dt.timedelta(days=(ordinal[1] - first.weekday()) % 7 + 7 * (ordinal[0] - 1))
            if day.month == first.month and day <= now:
                found.append(f"{day:%Y-%m-%d}")
            first = back(first, "month", 1)
        return found[a - 1 : b][::-1]
    out = []
    for n in range(b - 1, a - 2, -1):
        try:
            out.append(name_of(back(now, grain, n), grain))
        except (ValueError, OverflowError):
            continue
    return out


def end_of_day(day: dt.date, zone: str | None) -> dt.datetime:
    """The last microsecond of a local day, in UTC without a zone."""
    end = dt.datetime.combine(day, dt.time.max, tzinfo=zoneinfo.ZoneInfo(zone or "UTC"))
    return end.astimezone(dt.timezone.utc).replace(tzinfo=None)


