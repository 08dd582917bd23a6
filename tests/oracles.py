"""Plain, slow versions of the operators, written apart from them, to test against."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from fractions import Fraction
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
NAMED = {"CET": 60, "CEST": 120, "GMT": 0, "UTC": 0, "EST": -300, "EDT": -240, "JST": 540, "Z": 0}


def _ms(t: datetime) -> int:
    return (t - EPOCH) // timedelta(milliseconds=1)


def _in_zone(t: datetime, zone: str) -> int | None:
    out = set()
    for fold in (0, 1):
        u = t.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc)
        if u.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t:
            out.add(u.replace(tzinfo=None))
    return _ms(out.pop()) if len(out) == 1 else None


def utc_ms(text, calendar, zone, day_first):
    """The instant of a text by strptime and datetime, or None."""
    s = (text or "").strip()
    if re.fullmatch(r"\d+(\.\d+)?", s):
        for num, den in ((60000, 1), (1000, 1), (1, 1), (1, 1000)):
            ms = Fraction(s) * num / den
            if _ms(datetime(2000, 1, 1)) <= ms < _ms(datetime(2030, 1, 1)):
                return int(ms // 1)
        return None
    if m := re.fullmatch(r"([\d.]+) (days|hours) since (\d+)-(\d+)-(\d+)(?: 00:00:00)?", s):
        ms = round(Fraction(m[1]) * (86_400_000 if m[2] == "days" else 3_600_000))
        y, mo, d = int(m[3]), int(m[4]), int(m[5])
        cal = (calendar or "").lower()
        if "360" in cal:
            n = y * 360 + (mo - 1) * 30 + d - 1 + ms // 86_400_000
            y, mo, d = n // 360, n % 360 // 30 + 1, n % 30 + 1
        elif "leap" in cal or "365" in cal:
            lengths = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
            n = y * 365 + sum(lengths[: mo - 1]) + d - 1 + ms // 86_400_000
            y, n, mo = n // 365, n % 365, 1
            while n >= lengths[mo - 1]:
                n -= lengths[mo - 1]
                mo += 1
            d = n + 1
        else:
            return _ms(datetime(y, mo, d)) + ms
        try:
            return _ms(datetime(y, mo, d)) + ms % 86_400_000
        except ValueError:
            return None
    if m := re.fullmatch(r"(.*)\[(.+)\]|(\S+ \S+) ([A-Z][a-z]+/\S+)", s):
        s, zone = m[1] or m[3], m[2] or m[4]
    offset = None
    if m := re.fullmatch(r"(.*\d{2}:?\d{2}.*?) ?([+-]\d{2}):?(\d{2})|(.*\dT\d+|.*:\d+(?:\.\d+)?) ?(Z|UTC)", s):
        if m[1]:
            sign = -1 if m[2][0] == "-" else 1
            s, offset = m[1], sign * (abs(int(m[2])) * 60 + int(m[3]))
        else:
            s, offset = m[4], 0
    elif m := re.fullmatch(r"(\w+ \w+ \d+ [\d:]+) ([A-Z]+) (\d+)", s):
        s, offset = f"{m[1]} {m[3]}", NAMED[m[2]]
    slash = "%d/%m/%Y" if day_first else "%m/%d/%Y"
    extra = ""
    if m := re.fullmatch(r"(.*:\d{2})\.(\d+)", s):
        s, extra = m[1], m[2]
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y-%jT%H:%M", "%Y%m%dT%H%M%S", "%Y%m%dT%H%M", f"{slash} %H:%M", f"{slash} %I:%M %p", "%d %b %Y %H:%M", "%a %b %d %H:%M:%S %Y"):
        if form in ("%Y%m%dT%H%M%S", "%Y%m%dT%H%M") and len(s) != (15 if form.endswith("S") else 13):
            continue
        try:
            t = datetime.strptime(s, form)
            if "%j" in form and t.year != int(s[:4]):
                return None
            break
        except ValueError:
            pass
    else:
        return None
    t += timedelta(milliseconds=int((extra + "000")[:3]))
    return _in_zone(t, zone) if offset is None else _ms(t - timedelta(minutes=offset))


def _list(text, names=False):
    return None if text is None else tuple(x.lower() if names else int(float(x)) for x in re.findall(r"[a-zA-Z_][\w]*" if names else r"\d+(?:\.\d+)?", text))


def header_changes(files, variables, coordinates):
    """Changes between successive headers: ``files`` (agg_id, file_index, file_id); ``variables`` (file_id, name, full_name, shape, dims, dtype); ``coordinates`` (file_id, name, shape, dims)."""
    heads = {}
    for kind, rows in (("V", variables), ("C", coordinates)):
        for r in rows:
            f, name, full, shape, dims, dtype = r if kind == "V" else (r[0], r[1], None, r[2], r[3], None)
            x = heads.setdefault((f, kind), {}).setdefault(name, {"full": full and re.sub(r"[\s_]+", " ", full.lower()), "shape": None, "dims": None, "dtype": dtype})
            x["shape"], x["dims"] = x["shape"] if shape is None else _list(shape), x["dims"] if dims is None else _list(dims, True)
    order = {}
    for a, i, f in set(files):
        order.setdefault(a, []).append((i, f))
    out = set()
    for a in order:
        last = None
        for _, f in sorted(order[a]):
            for kind in "VC" if last is not None else "":
                cur, old = heads.get((f, kind), {}), heads.get((last, kind), {})
                came, left = sorted(set(cur) - set(old)), sorted(set(old) - set(cur))
                pairs = {n: n for n in set(cur) & set(old)}
                for n in list(came):
                    hit = next((o for o in left if kind == "V" and old[o]["full"] == cur[n]["full"] and cur[n]["full"]), None)
                    if hit:
                        left.remove(hit)
                        came.remove(n)
                        pairs[n] = hit
                        out.add((f, kind, n, "renamed"))
                out |= {(f, kind, n, "added") for n in came} | {(f, kind, n, "removed") for n in left}
                for n, o in pairs.items():
                    c, p = cur[n], old[o]
                    for what in ("shape", "dims"):
                        if c[what] is None:
                            c[what] = p[what]
                    if None not in (c["dims"], p["dims"]) and c["dims"] != p["dims"]:
                        out.add((f, kind, n, "dims"))
                    elif None not in (c["dims"], p["dims"], c["shape"], p["shape"]):
                        if [x for d, x in zip(c["dims"], c["shape"]) if d != "time"] != [x for d, x in zip(p["dims"], p["shape"]) if d != "time"]:
                            out.add((f, kind, n, "shape"))
                    if kind == "V" and c["dtype"] != p["dtype"]:
                        out.add((f, kind, n, "dtype"))
            last = f
    return out
