"""Calendar bins of a time column, in the Gregorian and in model calendars, and season filters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CYCLIC = {"monthofyear", "hourofday", "seasonofyear", "dayofyear"}
_INITIALS = "JFMAMJJASONDJFMAMJJASOND"
#: Calendars whose years all have the same number of days, by their names.
YEAR_DAYS = {"noleap": 365, "no_leap": 365, "365_day": 365, "all_leap": 366, "366_day": 366, "360_day": 360, "360": 360}
GREGORIAN = ("", "gregorian", "standard", "proleptic_gregorian", "default")


def season_months(text: str) -> list[int]:
    """Months of a run of month initials such as DJF, at its first occurrence in the year repeated."""
    at = _INITIALS.find(text.upper())
    if at < 0 or not text or len(text) > 12:
        raise ValueError(f"no season: {text}")
    return [(at + k) % 12 + 1 for k in range(len(text))]


def parts_of(m: Column, calendar: str = "gregorian") -> dict[str, Column]:
    """Year, month, dayofyear, hour and day (since 1970-01-01) of a time column.

    In the Gregorian calendar ``m`` holds timestamps; in a model calendar it holds milliseconds since its own 1970-01-01, as a date
    such as 30 February has no timestamp.
    """
    kind = calendar.strip().lower().replace(" ", "_")
    if kind in GREGORIAN:
        return {"year": F.year(m), "month": F.month(m), "dayofyear": F.dayofyear(m), "hour": F.hour(m), "day": F.datediff(m, F.lit("1970-01-01").cast("date"))}
    if kind not in YEAR_DAYS:
        raise ValueError(f"no calendar: {calendar}")
    n, ms = YEAR_DAYS[kind], m.cast("long")
    day = F.floor(ms / 86_400_000)
    of_year = F.pmod(day, F.lit(n))
    named = F.date_add(F.lit("2001-01-01" if n == 365 else "2000-01-01").cast("date"), of_year.cast("int"))
    month = F.floor(of_year / 30) + 1 if n == 360 else F.month(named)
    return {"year": (F.floor(day / n) + 1970).cast("int"), "month": month.cast("int"), "dayofyear": (of_year + 1).cast("int"), "hour": F.floor(F.pmod(ms, F.lit(86_400_000)) / 3_600_000).cast("int"), "day": day.cast("int")}


def months_of(m: Column, calendar: str = "gregorian") -> Column:
    return parts_of(m, calendar)["month"]


def calendar_bin(name: str, m: Column, compat: bool = False, calendar: str = "gregorian") -> Column:
    """The bin of the times ``m`` (see ``parts_of``) under a group name: monthOfYear, decade, year, month, hourOfDay, season, seasonOfYear, day, dayOfYear, N-year, N/offset-month, N-dayOfYear and so on.

    Division is floor division; December belongs to the next year's winter, and seasons are 0 DJF, 1 MAM, 2 JJA, 3 SON; with
    ``compat`` they are the literal ((month + 1) % 12) / 3 of the older servers, and December stays in its year.
    """
    kind = name.replace(" ", "").lower()
    p = parts_of(m, calendar)
    year, month, days = p["year"], p["month"], p["day"]
    months = (year - 1970) * 12 + month
    season = F.floor(((month + 1) % 12) / 3 if compat else (month % 12) / 3)
    plain = {
        "monthofyear": month,
        "decade": F.floor(year / 10),
        "year": year,
        "month": months,
        "hourofday": p["hour"],
        "season": (year + F.when(F.lit(not compat) & (month == 12), 1).otherwise(0) - 1970) * 4 + season,
        "seasonofyear": season,
        "day": days,
        "dayofyear": p["dayofyear"],
    }
    if kind in plain:
        return plain[kind].cast("int")
    if not (x := re.fullmatch(r"(\d+)(?:/(\d+))?-(year|month|monthofyear|day|dayofyear)", kind)) or int(x[1]) < 1:
        raise ValueError(f"no calendar group: {name}")
    n, offset = int(x[1]), int(x[2] or 0)
    base = {"year": year - 1970 + offset, "month": months + offset, "monthofyear": (month - 1 + offset) % 12, "day": days + offset, "dayofyear": p["dayofyear"] - 1 + offset}[x[3]]
    return F.floor(base / n).cast("int")


def cycle_bin(m: Column, resolution: str, period: int, cycles: int, offset: int = 0, first: int | None = None) -> Column:
    """The bin, 0 to ``cycles`` - 1, of steps counted in years, months or days, ``period`` of them to a bin; ``offset`` shifts the border between bins, and ``first`` is the step that the count starts at (the first one of the data).

    A step in the last days of a month, from the 22nd on, counts as the next month.
    """
    if offset > period:
        raise ValueError("the offset can't exceed the period")
    year, month = F.year(m), F.month(m)
    steps = {"year": year, "month": year * 12 + month - 1 + F.when(F.dayofmonth(m) >= 22, 1).otherwise(0), "day": F.datediff(m, F.lit("1970-01-01").cast("date"))}
    if resolution not in steps:
        raise ValueError(f"no resolution: {resolution}")
    start = first or 0
    shift = (period - (offset - start % period) % period) % period
    return F.pmod(F.floor((steps[resolution] - F.lit(start) + shift) / period), F.lit(cycles)).cast("int")


#: Lengths of time units in milliseconds.
UNIT_MILLIS = {"millisecond": 1, "msec": 1, "ms": 1, "second": 1000, "sec": 1000, "s": 1000, "minute": 60_000, "min": 60_000, "hour": 3_600_000, "hr": 3_600_000, "h": 3_600_000, "day": 86_400_000, "d": 86_400_000, "week": 604_800_000}


def duration_millis(text: str) -> float:
    """Milliseconds of a duration such as 6 hours, 1.5 day or month (a twelfth of 365.2425 days) and year."""
    m = re.fullmatch(r"\s*([\d.]+)?\s*([a-zA-Z]+?)s?\s*", text)
    n, unit = float(m[1] or 1) if m else 0, m[2].lower() if m else ""
    if unit in ("year", "month"):
        return n * 365.2425 * 86_400_000 / (12 if unit == "month" else 1)
    if unit in UNIT_MILLIS or f"{unit}s" in UNIT_MILLIS:
        return n * UNIT_MILLIS.get(unit, UNIT_MILLIS.get(f"{unit}s", 0))
    raise ValueError(f"no duration: {text}")
