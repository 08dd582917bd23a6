"""Names of units in columns and running text: quantity, size and zero point."""

from __future__ import annotations

import calendar
import math
import re
from datetime import datetime, timezone
from functools import lru_cache

# Dimensions are exponents of (length, mass, time, temperature).
_L, _M, _T, _K, _0 = (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0)
_PRESSURE, _POWER, _ENERGY, _FORCE = (-1, 1, -2, 0), (2, 1, -3, 0), (2, 1, -2, 0), (1, 1, -2, 0)
#: Symbols, case-sensitive.
SYMBOLS = {
    "m": (1, _L), "km": (1e3, _L), "cm": (1e-2, _L), "mm": (1e-3, _L), "dam": (10, _L), "hm": (100, _L), "gpm": (1, _L), "gpdm": (10, _L), "gpkm": (1e3, _L), "ft": (0.3048, _L), "in": (0.0254, _L), "mi": (1609.344, _L), "nmi": (1852, _L),
    "kg": (1, _M), "g": (1e-3, _M), "mg": (1e-6, _M), "ug": (1e-9, _M), "µg": (1e-9, _M),
    "s": (1, _T), "sec": (1, _T), "min": (60, _T), "h": (3600, _T), "hr": (3600, _T), "d": (86400, _T),
    "K": (1, _K), "degK": (1, _K), "deg_K": (1, _K), "cK": (1e-2, _K), "mK": (1e-3, _K),
    "Pa": (1, _PRESSURE), "hPa": (100, _PRESSURE), "kPa": (1e3, _PRESSURE), "MPa": (1e6, _PRESSURE), "mb": (100, _PRESSURE), "mbar": (100, _PRESSURE), "atm": (101325, _PRESSURE), "mmHg": (133.322387415, _PRESSURE),
    "W": (1, _POWER), "kW": (1e3, _POWER), "mW": (1e-3, _POWER), "MW": (1e6, _POWER), "J": (1, _ENERGY), "kJ": (1e3, _ENERGY), "MJ": (1e6, _ENERGY), "N": (1, _FORCE),
    "kn": (1852 / 3600, (1, 0, -1, 0)), "kt": (1852 / 3600, (1, 0, -1, 0)), "kts": (1852 / 3600, (1, 0, -1, 0)), "mph": (0.44704, (1, 0, -1, 0)), "kph": (1 / 3.6, (1, 0, -1, 0)), "kmh": (1 / 3.6, (1, 0, -1, 0)),
}
#: Words, in the singular.
WORDS = {
    "metre": "m", "meter": "m", "gramme": "g", "gram": "g", "second": "s", "minute": "min", "hour": "h", "day": "d", "kelvin": "K", "pascal": "Pa", "watt": "W", "joule": "J", "newton": "N",
    "foot": "ft", "feet": "ft", "inch": "in", "inche": "in", "mile": "mi", "knot": "kn", "millibar": "mb", "kilo": "kg", "hectopascal": "hPa",
}
PREFIXES = {"micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "deci": 0.1, "deca": 10, "hecto": 100, "kilo": 1e3, "mega": 1e6, "giga": 1e9}
PARTS = {"tenth": 0.1, "hundredth": 1e-2, "thousandth": 1e-3, "millionth": 1e-6, "billionth": 1e-9, "ten": 10, "hundred": 100, "thousand": 1e3, "million": 1e6}
RATIOS = {"%": 0.01, "percent": 0.01, "per cent": 0.01, "pct": 0.01, "permille": 1e-3, "per mille": 1e-3, "per mil": 1e-3, "‰": 1e-3, "parts per thousand": 1e-3, "parts per million": 1e-6, "ppm": 1e-6, "fraction": 1, "0-1": 1, "1": 1, "proportion": 1}
CELSIUS, FAHRENHEIT = re.compile(r"(?:°|deg(?:ree)?s?\.?[ _]?)?(?:c|celsius|centigrade)", re.I), re.compile(r"(?:°|deg(?:ree)?s?\.?[ _]?)?(?:f|fahrenheit)", re.I)
QUANTITIES = {_K: "temperature", _PRESSURE: "pressure", _L: "length", (1, 0, -1, 0): "speed", _0: "ratio", (-2, 1, -1, 0): "water_flux", (0, 1, -3, 0): "energy_flux"}
MINUTES = {"second": 1 / 60, "sec": 1 / 60, "s": 1 / 60, "minute": 1, "min": 1, "hour": 60, "hr": 60, "h": 60, "day": 1440, "d": 1440, "millisecond": 1 / 60000}
_SINCE = re.compile(r"([a-z]+?)s?\s+since\s+(-?\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d*)?)?)?\s*(?:z|utc|gmt)?", re.I)
_NUMBER = re.compile(r"(10(?:\^|\*\*)[+-]?\d+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?:\s*[*x]\s*|\s+)(?=\D)")


def _term(word: str) -> tuple[float, tuple] | None:
    if word in SYMBOLS:
        return SYMBOLS[word]
    w = word.lower()
    for x in (w, w.removesuffix("s"), w.removesuffix("es")):
        if x in WORDS:
            return SYMBOLS[WORDS[x]]
        if x in ("bar",):
            return 1e5, _PRESSURE
        for p, size in PREFIXES.items():
            rest = x.removeprefix(p)
            if rest != x and (rest in WORDS or rest == "bar"):
                size0, dims = _term(rest)
                return size * size0, dims
    return None


@lru_cache(maxsize=65536)
def parse_unit(text: str | None, hint: str = "") -> tuple[str, float, float] | None:
    """``(quantity, factor, offset)`` with value * factor + offset in the quantity's common unit, or None if the text names no unit.

    ``hint`` is X or Y for an axis: it tells longitudes and latitudes in radians or plain degrees apart.
    """
    s = re.sub(r"\s+", " ", (text or "").strip())
    if not s:
        return None
    if m := _SINCE.fullmatch(s):
        if m[1].lower() not in MINUTES:
            return None
        y, mo, d, h, mi, sec = (int(x or 0) for x in m.groups()[1:])
        if not (1 <= y and 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(y, mo)[1] and h < 24 and mi < 60 and sec < 60):
            return None
        return "time", MINUTES[m[1].lower()], (datetime(y, mo, d, h, mi, sec, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() / 60
    if s.lower() in RATIOS:
        return "ratio", RATIOS[s.lower()], 0.0
    if re.fullmatch(r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", s):
        return ("ratio", float(s), 0.0) if float(s) else None
    low = s.lower().replace("_", " ")
    if m := re.fullmatch(r"(deg(?:ree)?s?\.?|°) ?(n(?:orth)?|e(?:ast)?)", low):
        return ("latitude" if m[2][0] == "n" else "longitude"), 1.0, 0.0
    if re.fullmatch(r"rad(ian)?s?( north| east)?", low) or re.fullmatch(r"deg(ree)?s?|°", low):
        quantity = {"X": "longitude", "Y": "latitude"}.get(hint)
        return (quantity, math.degrees(1) if low[0] == "r" else 1.0, 0.0) if quantity else None
    scale = 1.0
    if m := re.match(r"(\w+?)s? of (?:an? |the )?", s):
        if m[1].lower() in PARTS:
            scale, s = PARTS[m[1].lower()], s[m.end() :]
    if m := _NUMBER.match(s):
        scale, s = scale * (10.0 ** int(re.split(r"\^|\*\*", m[1])[1]) if m[1][:3] in ("10^", "10*") else float(m[1])), s[m.end() :]
    if CELSIUS.fullmatch(s):
        return "temperature", scale, 273.15
    if FAHRENHEIT.fullmatch(s):
        return "temperature", scale * 5 / 9, 273.15 - 32 * 5 / 9
    if re.fullmatch(r"deg(ree)?s?[ _.]*k(elvin)?", s, re.I):
        s = "K"
    factor, dims, masses, depth, seen = scale, [0, 0, 0, 0], [0, 0], False, False
    sign = 1
    s = re.sub(r"\bsquare (\w+)", r"\g<1>2", s)
    for piece in re.split(r"(/| per )", s):
        if piece in ("/", " per "):
            sign = -1
            continue
        for w in re.split(r"[ .·*]+(?![*\d-])", piece.strip()):
            m = re.fullmatch(r"([A-Za-zµ_]+)(?:\^|\*\*)?([+-]?\d+)?", w)
            t = m and _term(m[1])
            if not t:
                return None
            power = sign * int(m[2] or 1)
            factor *= t[0] ** power
            seen = True
            dims = [a + power * b for a, b in zip(dims, t[1])]
            if t[1] == _M:
                masses[power < 0] += 1
            depth |= power == 1 and m[1].lower() in ("mm", "millimetre", "millimetres", "millimeter", "millimeters", "in", "inch", "inches")
    if not seen:
        return None
    quantity = QUANTITIES.get(tuple(dims))
    if quantity == "ratio":
        quantity = "mass_ratio" if masses == [1, 1] else None
    if quantity == "speed" and depth:  # a depth of water: one millimetre on a square metre is a kilogram
        quantity, factor = "water_flux", factor * 1000
    return (quantity, factor, 0.0) if quantity else None


#: Where a text names a unit; the first place that holds one counts.
PLACES = [re.compile(x, re.I) for x in (r"\[([^\[\]]+)\]", r"\bunits?\s*[:=]\s*([^;]+)", r"\b(?:are|is|were)\s+(?:given|expressed|reported|measured|recorded)\s+in\s+([^;]+)", r"\b(?:reported|expressed|measured|recorded|given|values are|stored)\s+in\s+([^;]+)", r"\bstored as\s+([^;,]+)", r"\(([^()]+)\)", r"\sin\s+([^;]+)")]


@lru_cache(maxsize=65536)
def unit_in_text(text: str | None, hint: str = "") -> tuple[str, float, float] | None:
    """The unit that a running text names, as ``parse_unit`` gives it; None if it names none."""
    for place in PLACES:
        for m in place.finditer(text or ""):
            found = m[1].strip()
            for x in (found, found.removesuffix(".")):
                if unit := parse_unit(x, hint):
                    return unit
    return None


def resolve_unit(units: str | None, text: str | None, hint: str = "") -> tuple[str | None, float | None, float | None, str | None]:
    """``(quantity, factor, offset, named_by)``: the units column counts where it names a unit, otherwise the text; ``named_by`` is column, text or None."""
    if unit := parse_unit(units, hint):
        return (*unit, "column")
    if unit := unit_in_text(text, hint):
        return (*unit, "text")
    return None, None, None, None
