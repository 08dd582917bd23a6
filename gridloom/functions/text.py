"""Small texts of requests and settings."""

from __future__ import annotations

import re

#: Powers of 1024 by their letter.
SIZES = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4}


def parse_size(text: str) -> int:
    """Bytes of a size such as 200M, 1.5gb or 4096."""
    m = re.fullmatch(r"\s*([\d.]+)\s*([kmgt]?)b?\s*", str(text).lower())
    if not m:
        raise ValueError(f"no size: {text}")
    return int(float(m[1]) * 1024 ** SIZES[m[2]])


def unquoted(text: str) -> str:
    """The text without quotes around it."""
    s = text.strip()
    while len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        s = s[1:-1].strip()
    return s


def uid(name: str, *parts: str) -> str:
    """An id from a name and further parts: lower case, joined by hyphens, only letters, digits and ``_.-``."""
    return re.sub(r"[^a-z0-9_.-]", "", "-".join(x.strip().lower() for x in (name, *parts) if x))
