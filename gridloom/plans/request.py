"""Requests in the declarative form ``[domain=[{...}],variable=[{...}],operation=[{...}]]``: parsing and binding."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from graphlib import CycleError, TopologicalSorter

from gridloom.operators.cube import Span

_TOKEN = re.compile(r"""\s*(?:(?P<p>[\[\]{},;:=])|"(?P<s>[^"]*)"|'(?P<q>[^']*)'|(?P<w>[^\s\[\]{},;:="']+))""")


def parse(text: str) -> dict[str, list[dict]]:
    """The declarations of a request: name to list of objects, with keys in lower case. Strings, numbers, booleans, lists and nested objects are values."""
    tokens: list[tuple[str, str]] = []
    at = 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if not text[at:].strip():
                break
            raise ValueError(f"unreadable at {at}: {text[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup or ""
        tokens.append(("str" if kind in "sq" else kind, m[kind]))
    pos = 0

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal pos
        if pos >= len(tokens) or (expected and tokens[pos] != ("p", expected)):
            raise ValueError(f"{expected or 'more'} expected, {tokens[pos][1] if pos < len(tokens) else 'the end'} found")
        pos += 1
        return tokens[pos - 1]

    def peek(c: str) -> bool:
        return pos < len(tokens) and tokens[pos] == ("p", c)

    def word(w: str):
        low = w.lower()
        if low in ("true", "false"):
            return low == "true"
        for kind in (int, float):
            try:
                return kind(w)
            except ValueError:
                pass
        return w

    def value():
        if peek("{"):
            return obj()
        if peek("["):
            take("[")
            out = []
            while not peek("]"):
                out.append(value())
                if peek(",") or peek(";"):
                    take()
            take("]")
            return out
        kind, w = take()
        if kind == "p":
            raise ValueError(f"value expected, {w} found")
        return w if kind == "str" else word(w)

    def obj() -> dict:
        take("{")
        out = {}
        while not peek("}"):
            _, k = take()
            take(":")
            out[k.lower()] = value()
            if peek(","):
                take()
        take("}")
        return out

    out: dict[str, list[dict]] = {}
    take("[")
    while not peek("]"):
        _, name = take()
        take("=")
        v = value()
        out[name.lower()] = v if isinstance(v, list) else [v]
        if peek(",") or peek(";"):
            take()
    take("]")
    if pos != len(tokens):
        raise ValueError("text after the request")
    return out


AXES = [("y", r"lat"), ("x", r"lon"), ("z", r"p?lev"), ("t", r"tim")]
#: Forms of dates in requests beside ISO texts.
DATES = ["%Y", "%Y-%m", "%Y/%m/%d", "%m/%d/%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y", "%B %Y", "%b %Y"]
SYSTEMS = ("indices", "values", "timestamps")


def instant(text: object) -> str:
    """An ISO text without zone, in UTC, of a date or time written in a request."""
    s = " ".join(str(text).split())
    try:
        t = datetime.fromisoformat(s)
    except ValueError:
        for form in DATES:
            try:
                t = datetime.strptime(s, form)
                break
            except ValueError:
                continue
        else:
            raise ValueError(f"no time: {text}") from None
    if t.tzinfo:
        t = t.astimezone(timezone.utc).replace(tzinfo=None)
    return t.isoformat(sep=" ")


@dataclass(frozen=True)
class Domain:
    """The spans of a domain, the name of its mask, and whatever else it states."""

    spans: list[Span] = field(default_factory=list)
    mask: str | None = None
    more: dict = field(default_factory=dict)


def spans(domain: dict) -> list[Span]:
    """The spans of a domain object; ``crs`` stands for ``system``, a bare number or time for a single value, ``filter`` for a season."""
    out = []
    for k, v in domain.items():
        axis = next((a for a, p in AXES if re.match(p, k)), None)
        if axis is None:
            continue
        if not isinstance(v, dict):
            out.append(Span(axis, instant(v) if axis == "t" else float(v), None, "values"))
            continue
        if unknown := set(v) - {"start", "end", "system", "crs", "bounds", "filter"}:
            raise ValueError(f"no part of an axis: {', '.join(sorted(unknown))}")
        system = str(v.get("system", v.get("crs", "values"))).lower()
        if system not in SYSTEMS:
            raise ValueError(f"no coordinate system: {system}")
        start, end = v.get("start"), v.get("end")
        if axis == "t" and system != "indices":
            start, end = (None if x is None else instant(x) for x in (start, end))
            if start is not None and end is not None and start == end:
                end = None
        out.append(Span(axis, start, end, system, v.get("filter")))
    return out


@dataclass
class Operation:
    """One kernel call of a request."""

    name: str
    inputs: list[str]
    id: str
    domain: str | None
    config: dict


@dataclass
class Request:
    """A bound request: input names by id, domains by id, operations in order of need."""

    variables: dict[str, tuple[str, str]]
    variable_domain: dict[str, str]
    domains: dict[str, Domain]
    operations: list[Operation] = field(default_factory=list)


#: Kinds of places that a variable's uri may name; anything else is an error.
SCHEMES = ("collection", "file", "parquet", "fragment")


def collection_of(variable: dict) -> str:
    """The place that a variable names: the id of a collection, or ``scheme:path``."""
    text = str(variable.get("uri", variable.get("collection", variable.get("path", ""))))
    scheme, colon, rest = text.partition(":")
    if not colon:
        return f"file:{text}" if "path" in variable and not set(variable) & {"uri", "collection"} else text.strip("/")
    if scheme.lower() not in SCHEMES:
        raise ValueError(f"no source of inputs: {scheme}")
    return rest.strip("/") if scheme.lower() == "collection" else f"{scheme.lower()}:/{rest.lstrip('/')}"


def bind(parsed: dict[str, list[dict]]) -> Request:
    """Resolve ids, give a request without operations a subset, infer domains both ways, order operations by their inputs."""
    if unknown := set(parsed) - {"domain", "variable", "operation"}:
        raise ValueError(f"no declaration: {', '.join(sorted(unknown))}")
    domains = {}
    for d in parsed.get("domain", []):
        more = {k: v for k, v in d.items() if k not in ("name", "id", "mask") and not any(re.match(p, k) for _, p in AXES)}
        domains[str(d.get("name", d.get("id"))).lower()] = Domain(spans(d), str(d["mask"]).lstrip("#").lower() if "mask" in d else None, more)
    variables: dict[str, tuple[str, str]] = {}
    vdom: dict[str, str] = {}
    for v in parsed.get("variable", []):
        place = collection_of(v)
        for item in str(v.get("name", "*")).split(","):
            name, _, uid = item.strip().partition(":")
            uid = (uid or str(v.get("id", name))).lower()
            if uid in variables:
                raise ValueError(f"two inputs are called {uid}")
            variables[uid] = (place, name)
            if "domain" in v:
                vdom[uid] = str(v["domain"]).lower()
    ops = []
    for k, o in enumerate(parsed.get("operation") or [{"name": "cube.noop", "input": ",".join(variables)}]):
        raw = o.get("input", "")
        inputs = [str(x).strip().lower() for x in (raw if isinstance(raw, list) else str(raw).split(",")) if str(x).strip()]
        known = {"name", "input", "id", "result", "domain"}
        ops.append(Operation(str(o["name"]).lower(), inputs, str(o.get("id", o.get("result", f"op{k}"))).lower(), str(o["domain"]).lower() if "domain" in o else None, {a: b for a, b in o.items() if a not in known}))
    by_id = {o.id: o for o in ops}
    if len(by_id) < len(ops):
        raise ValueError("two operations have one id")
    for o in ops:
        for i in o.inputs:
            if i not in variables and i.partition(".")[0] not in by_id:
                raise ValueError(f"no input {i}")
        for dom in [o.domain, *vdom.values()]:
            if dom and dom not in domains:
                raise ValueError(f"no domain {dom}")
    # an operation without a domain takes its inputs' one, an input without one that of its operation
    for _ in ops:
        for o in ops:
            seen = {vdom[i] for i in o.inputs if i in vdom} | {by_id[i].domain for i in o.inputs if i in by_id and by_id[i].domain}
            if o.domain is None and len(seen) == 1:
                o.domain = seen.pop()
    try:
        order = list(TopologicalSorter({o.id: [i.partition(".")[0] for i in o.inputs if i.partition(".")[0] in by_id] for o in ops}).static_order())
    except CycleError as e:
        raise ValueError("operations depend on each other in a circle") from e
    return Request(variables, vdom, domains, [by_id[i] for i in order])
