"""Timestamps of mixed form, precision and zone to one UTC instant."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache, reduce
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.blocks import join_same

#: Abbreviations and their usual offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480,
    "HST": -600, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "BRT": -180, "ART": -180, "IST": 330, "NPT": 345, "PKT": 300,
    "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "SAST": 120,
}
#: Calendars in which each year has 365 days, or 12 months of 30.
NOLEAP, DAYS360 = ["noleap", "no_leap", "365_day", "365day"], ["360_day", "360day", "360"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_ZONE = r"\s*(Z|[+-]\d{2}(?::?\d{2})?|\[[^\]]+\]|(?!(?:AM|PM|am|pm)\b)[A-Za-z]+(?:[/_+-][A-Za-z0-9_+-]+)*)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_NAME = r"([A-Za-z]{3})[A-Za-z]*\.?"
#: Each form: pattern, and where year, month, day, day of year, hour, minute, second, fraction, AM or PM and zone are; # holds the two numbers of a date with slashes.
FORMS = [
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[T ]+{_CLOCK}{_ZONE})?$", "$1|$2|$3||$4|$5|$6|$7||$8|"),
    (rf"^(\d{{4}})-(\d{{3}})(?:[T ]{_CLOCK}{_ZONE})?$", "$1|||$2|$3|$4|$5|$6||$7|"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3||$4|$5|$6|$7||$8|"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:[T ]+{_CLOCK}(?:\s*([AaPp][Mm]))?{_ZONE})?$", "$3||||$4|$5|$6|$7|$8|$9|$1#$2"),
    (rf"^(\d{{1,2}}) {_NAME} (\d{{4}})(?: {_CLOCK}{_ZONE})?$", "$3|$2|$1||$4|$5|$6|$7||$8|"),
    (rf"^[A-Za-z]{{3,9}},? {_NAME} (\d{{1,2}}) {_CLOCK} ([A-Za-z]+|[+-]\d{{2}}:?\d{{2}}) (\d{{4}})$", "$8|$1|$2||$3|$4|$5|$6||$7|"),
]
_COUNT = r"(?i)^([+-]?\d+(?:\.\d+)?)\s*(day|hour|minute|second|millisecond)s?\s+since\s+(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?\s*(?:Z|UTC)?$"
_LOW, _HIGH = 946_684_800_000, 1_893_456_000_000  # 2000-01-01 and 2030-01-01


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, null for one that does not exist."""
    return F.unix_date(F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")).cast("long")


def _bare(text: Column) -> Column:
    """Epoch milliseconds of a bare number: minutes, seconds, milliseconds or microseconds, whichever lies in 2000 to 2030."""
    n = F.when(text.rlike(r"^\d{1,20}(\.\d+)?$"), text.try_cast("decimal(30,6)"))
    tries = [F.floor(n * F.lit(x).cast("decimal(9,3)")).try_cast("long") for x in ("60000", "1000", "1", "0.001")]
    return F.coalesce(*[F.when((t >= _LOW) & (t < _HIGH), t) for t in tries])


def _counted(text: Column, calendar: Column) -> Column:
    """Epoch milliseconds of a count since a date in the named calendar: the civil date of the name that the count reaches."""
    part = lambda i: F.regexp_extract(text, _COUNT, i)
    scale = F.create_map(*[F.lit(x) for kv in {"day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}.items() for x in kv])
    y, m, d = (part(i).try_cast("int") for i in (3, 4, 5))
    clock = F.coalesce(part(6).try_cast("long"), F.lit(0)) * 3_600_000 + F.coalesce(part(7).try_cast("long"), F.lit(0)) * 60_000 + F.coalesce(part(8).try_cast("long"), F.lit(0)) * 1000
    ms = F.round(part(1).try_cast("decimal(28,12)") * F.element_at(scale, F.lower(part(2))).cast("decimal(10,0)")).try_cast("long") + clock
    passed, rest = F.floor(ms / F.lit(86_400_000)).cast("long"), F.pmod(ms, F.lit(86_400_000))
    kind = F.lower(F.trim(F.coalesce(calendar, F.lit(""))))
    civil = _days(y, m, d) + passed
    # 365 days a year: the day's number in a year without 29 February
    base = y.cast("long") * 365 + F.dayofyear(F.try_make_timestamp_ntz(F.lit(2001), m, d, F.lit(0), F.lit(0), F.lit(0))) - 1 + passed
    in_year = F.date_add(F.lit("2001-01-01").cast("date"), F.pmod(base, F.lit(365)).cast("int"))
    common = _days(F.floor(base / 365).cast("int"), F.month(in_year), F.dayofmonth(in_year))
    flat = y.cast("long") * 360 + (m - 1) * 30 + d - 1 + passed
    thirty = _days(F.floor(flat / 360).cast("int"), (F.floor(F.pmod(flat, F.lit(360)) / 30) + 1).cast("int"), (F.pmod(flat, F.lit(30)) + 1).cast("int"))
    days = F.when(kind.isin(NOLEAP), common).when(kind.isin(DAYS360), thirty).otherwise(civil)
    return F.when(text.rlike(_COUNT), days * 86_400_000 + rest)


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that the optimizer evaluates once: it doesn't merge projections or push filters through a generator."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parsed(df: DataFrame, text: str, calendar: str, day_first: str) -> DataFrame:
    """``df`` with ``_fixed`` (epoch ms of texts that need no zone), ``_local`` (ms of the written date and clock as if UTC), ``_offset`` (minutes, if the text gives one) and ``_zone`` (a zone's name, if the text gives one).

    All are null for a null, empty or unusable text. The columns ``calendar`` and ``day_first`` may be null (Gregorian; month first).
    """
    clean = F.trim(F.col(text))
    form = reduce(lambda rest, f: F.when(clean.rlike(f[0]), F.regexp_replace(clean, f[0], f[1])).otherwise(rest), reversed(FORMS), F.lit(None).cast("string"))
    # step by step, as one method with all of this would be too long for the JVM to compile
    kept = df.columns
    df = _held(df, _f=F.split(form, r"\|"))
    part = lambda i: F.col("_f")[i]
    num = lambda c: c.try_cast("int")
    one, two = (num(F.split(part(10), "#")[i]) for i in (0, 1))
    slashed, first = part(10).contains("#"), F.coalesce(F.col(day_first), F.lit(False))
    names = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS) for x in (m, k + 1)])
    month = F.when(slashed, F.when(first, two).otherwise(one)).when(part(1).rlike(r"^\d+$"), num(part(1))).when(part(1) != "", F.try_element_at(names, F.lower(F.substring(part(1), 1, 3))))
    day = F.when(slashed, F.when(first, one).otherwise(two)).otherwise(num(part(2)))
    df = _held(df, _year=num(part(0)), _month=month, _day=day)
    ordinal = F.when(num(part(3)).between(1, 366), _days(F.col("_year"), F.lit(1), F.lit(1)) + num(part(3)) - 1)
    ordinal = F.when(F.year(F.date_add(F.lit("1970-01-01").cast("date"), ordinal.cast("int"))) == F.col("_year"), ordinal)
    df = _held(df, _days=F.when(part(3) != "", ordinal).otherwise(_days(F.col("_year"), F.col("_month"), F.col("_day"))))
    df = _held(df, **{f"_c{i}": F.when(part(i) == "", F.lit(0)).otherwise(num(part(i))) for i in (4, 5, 6)})
    hour, minute, second = (F.col(f"_c{i}") for i in (4, 5, 6))
    hour = F.when(part(8) == "", hour).when(hour.between(1, 12), hour % 12 + F.when(part(8).isin("PM", "pm", "Pm", "pM"), 12).otherwise(0))
    fraction = F.when(part(7) == "", F.lit(0)).otherwise(F.rpad(F.substring(part(7), 1, 3), 3, "0").try_cast("int"))
    df = _held(df, _clock=F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), (hour.cast("long") * 3600 + minute * 60 + second) * 1000 + fraction), _written=F.regexp_replace(part(9), r"[\[\]]", ""))
    written = F.col("_written")
    abbreviations = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    digits = F.regexp_replace(F.substring(written, 2, 9), ":", "")
    signed = F.when(F.substring(written, 1, 1) == "-", -1).otherwise(1) * (num(F.substring(digits, 1, 2)) * 60 + F.coalesce(num(F.substring(digits, 3, 2)), F.lit(0)))
    offset = F.when(written == "", F.lit(None).cast("int")).when(F.substring(written, 1, 1).isin("+", "-"), signed).otherwise(F.coalesce(F.try_element_at(abbreviations, written), F.try_element_at(abbreviations, F.upper(written))))
    df = _held(df, _offset=offset.cast("int"))
    df = _held(df, _fixed=F.coalesce(_bare(clean), _counted(clean, F.col(calendar))))
    return df.select(*kept, "_fixed", (F.col("_days") * 86_400_000 + F.col("_clock")).alias("_local"), "_offset", F.when((written != "") & F.col("_offset").isNull(), written).alias("_zone"))


def _wall(ms: Column, zone: Column) -> Column:
    """The wall clock at a UTC instant, as ms as if UTC."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def unambiguous(local: Column, zone: Column, known: list[str]) -> Column:
    """The one UTC instant (ms) at which clocks in ``zone`` show ``local``; null if they skip it, show it twice, or the zone is unknown."""
    zone = F.when(zone.isin(known), zone)
    day = F.lit(26 * 3_600_000)
    before, after = local - (_wall(local - day, zone) - (local - day)), local - (_wall(local + day, zone) - (local + day))
    first, second = _wall(before, zone) == local, _wall(after, zone) == local
    return F.when(first & second & (before != after), F.lit(None)).when(first, before).when(second, after)


def zones_known(df: DataFrame) -> list[str]:
    """The zone names that the JVM knows (a fixed list of some 600)."""
    return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


#: Years in which offset histories are compared, and the share that the violations of a group's siblings have beside its own.
YEARS, SIBLINGS = (1990, 2036), 0.1


@lru_cache(maxsize=1)
def offset_histories() -> tuple[tuple[tuple[str, ...], np.ndarray, np.ndarray], ...]:
    """``(zone names, from when (UTC ms), offset in minutes)``: the distinct histories of offsets of all zones in ``YEARS``, some 240. Changes are found by halving four weeks to a quarter of an hour."""
    first, last = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in YEARS)
    found: dict[tuple, list[str]] = {}
    for name in sorted(available_timezones()):
        zone = ZoneInfo(name)
        offset = lambda t: round(datetime.fromtimestamp(t, zone).utcoffset().total_seconds() / 60)  # noqa: B023, E731
        since, offsets, t = [first], [offset(first)], first
        while t < last:
            end = min(t + 28 * 86_400, last)
            while offset(end) != offsets[-1]:
                low, high = t, end
                while high - low > 900:
                    middle = (low + high) // 1800 * 900
                    low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
                since.append(high)
                offsets.append(offset(high))
                t = high
            t = end
        found.setdefault((tuple(since), tuple(offsets)), []).append(name)
    return tuple((tuple(names), np.array(since, np.int64) * 1000, np.array(offsets)) for (since, offsets), names in found.items())


def history_of_zones(spark: SparkSession) -> DataFrame:
    """``(zone, history)``: the number of each zone's offset history."""
    return spark.createDataFrame([(z, k) for k, (names, _, _) in enumerate(offset_histories()) for z in names], "zone string, history int")


def estimated_zones(df: DataFrame, group: str, sibling: str, preferred: list[str], expected: str, slack_ms: int = 1000) -> DataFrame:
    """``(group, zone, history, violations, rows)``: for each group the offset history that its zoneless texts violate least.

    ``df`` is the output of ``parsed`` with ``expected``, the instant (ms) that the row's place in its sequence, or another delivery of
    its content, asks for. A zoneless text violates a history if the clock it shows isn't that history's at the expected instant, give or
    take ``slack_ms``. All offset histories of the zone database compete. Groups with the same ``sibling`` (collections of a site)
    lend each other a share of their violations, so one with few texts, or none, gets the history of its siblings. Ties go to
    histories of zones in ``preferred``, then to the alphabetically first. Rows are counted per quarter of an hour and implied offset
    first, so a hot group is no hot key. A null group or sibling is one of its own; siblings without any such text do not appear.
    """
    gap = F.col("_local") - F.col(expected)
    minutes = F.round(gap / 60_000)
    bare = df.where(F.col("_local").isNotNull() & F.col("_offset").isNull() & F.col("_zone").isNull() & F.col(expected).isNotNull())
    bare = bare.select(F.col(group).alias("_g"), F.col(sibling).alias("_s"), (F.floor(F.col(expected) / 900_000) * 900_000).alias("at"), F.when(F.abs(gap - minutes * 60_000) <= slack_ms, minutes).otherwise(10**6).cast("int").alias("offset"))
    votes = bare.groupBy("_g", "_s", "at", "offset").agg(F.count(F.lit(1)).alias("n"))
    sent = df.sparkSession.sparkContext.broadcast([(since, offsets) for _, since, offsets in offset_histories()])

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            place: dict[tuple, int] = {}
            own = np.array([place.setdefault(k, len(place)) for k in keys])
            at, offset, n = (b.column(k).to_numpy() for k in (2, 3, 4))
            total = np.bincount(own, n, len(place)).astype(np.int64)
            bad = [np.bincount(own, np.where(offsets[np.clip(np.searchsorted(since, at, "right") - 1, 0, None)] != offset, n, 0), len(place)) for since, offsets in sent.value]
            groups, siblings = ([k[c] for k in place] * len(bad) for c in (0, 1))
            yield pa.RecordBatch.from_pydict({"_g": pa.array(groups, pa.string()), "_s": pa.array(siblings, pa.string()), "history": pa.array(np.repeat(np.arange(len(bad), dtype=np.int32), len(place))), "bad": pa.array(np.concatenate(bad).astype(np.int64)), "n": pa.array(np.tile(total, len(bad)))})

    part = votes.select(F.col("_g").cast("string"), F.col("_s").cast("string"), "at", "offset", "n").mapInArrow(tried, "_g string, _s string, history int, bad bigint, n bigint")
    cost = part.groupBy("_g", "_s", "history").agg(F.sum("bad").alias("violations"), F.sum("n").alias("rows")).checkpoint()
    shared = cost.groupBy("_s", "history").agg(F.sum("violations").alias("_bad"))
    groups = df.select(F.col(group).cast("string").alias("_g"), F.col(sibling).cast("string").alias("_s")).distinct()
    every = join_same(groups, shared, ["_s"])
    every = join_same(every, cost.select("_g", "_s", "history", "violations", "rows"), ["_g", "_s", "history"], "left").fillna(0, ["violations", "rows"])
    wanted = set(preferred)
    names = [(k, min([z for z in zones if z in wanted] or zones), not wanted & set(zones)) for k, (zones, _, _) in enumerate(offset_histories())]
    known = df.sparkSession.createDataFrame(names, "history int, zone string, other boolean")
    order = F.struct((F.col("violations") + SIBLINGS * F.col("_bad")).alias("cost"), "other", "zone", "history", "violations", "rows")
    best = every.join(F.broadcast(known), "history").groupBy("_g").agg(F.min(order).alias("b"))
    return best.select(F.col("_g").alias(group), "b.zone", "b.history", "b.violations", "b.rows")


def resolved(df: DataFrame, site_zone: str, name: str) -> DataFrame:
    """``df`` (an output of ``parsed``) with the UTC instant ``name`` in ms, null where the text determines none; ``site_zone`` serves texts without a zone."""
    local, offset, zone = F.col("_local"), F.col("_offset"), F.coalesce(F.col("_zone"), F.col(site_zone))
    instant = F.coalesce("_fixed", F.when(offset.isNotNull(), local - offset * 60_000).otherwise(unambiguous(local, zone, zones_known(df))))
    return _held(df, **{name: instant}).drop("_fixed", "_local", "_offset", "_zone")
