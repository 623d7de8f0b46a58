"""Sigma rules as Columns.

A rule is a dictionary (or a YAML document). Its detection becomes one Boolean
Column over the raw JSON text of events; a value of the rule is only ever a
literal. Matching is case-insensitive for ASCII letters, and follows SQL's
logic for nulls: a negated selection on a missing field does not match, unless
nulls_match is set.
"""

from __future__ import annotations

import base64
import ipaddress
import itertools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J

#: Dashes that the windash modifier stands for.
DASHES = ("-", "/", "–", "—", "―")
#: Event channels and ids of log sources, and other names of fields in a route.
SYSMON, SECURITY = "Microsoft-Windows-Sysmon/Operational", "Security"
ROUTES = {
    "process_creation": ((SYSMON, 1, {}), (SECURITY, 4688, {"Image": "NewProcessName", "ParentImage": "ParentProcessName"})),
    "network_connection": ((SYSMON, 3, {}),),
    "file_event": ((SYSMON, 11, {}),),
    "dns_query": ((SYSMON, 22, {}),),
    "process_termination": ((SYSMON, 5, {}),),
    "driver_load": ((SYSMON, 6, {}),),
    "image_load": ((SYSMON, 7, {}),),
    "create_remote_thread": ((SYSMON, 8, {}),),
    "raw_access_thread": ((SYSMON, 9, {}),),
    "process_access": ((SYSMON, 10, {}),),
    "registry_add": ((SYSMON, 12, {}),),
    "registry_delete": ((SYSMON, 12, {}),),
    "registry_set": ((SYSMON, 13, {}),),
    "registry_rename": ((SYSMON, 14, {}),),
    "create_stream_hash": ((SYSMON, 15, {}),),
    "pipe_created": ((SYSMON, 17, {}), (SYSMON, 18, {})),
    "wmi_event": ((SYSMON, 19, {}), (SYSMON, 20, {}), (SYSMON, 21, {})),
    "file_delete": ((SYSMON, 23, {}), (SYSMON, 26, {})),
}
#: Channels of services, where the service alone says what events a rule is for.
SERVICES = {
    "security": ("Security",), "system": ("System",), "application": ("Application",), "sysmon": (SYSMON,), "powershell": ("Microsoft-Windows-PowerShell/Operational",),
    "taskscheduler": ("Microsoft-Windows-TaskScheduler/Operational",), "windefend": ("Microsoft-Windows-Windows Defender/Operational",),
}
LEVELS = ("informational", "low", "medium", "high", "critical")
_TEXT_MODIFIERS = {"contains", "startswith", "endswith"}
_NUMERIC = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
_ENCODERS: dict[str, str] = {"wide": "utf-16-le", "utf16le": "utf-16-le", "utf16be": "utf-16-be", "utf16": "utf-16"}
_KNOWN = _TEXT_MODIFIERS | set(_NUMERIC) | set(_ENCODERS) | {"re", "i", "m", "s", "cased", "all", "cidr", "base64", "base64offset", "windash", "fieldref", "expand", "exists", "neq"}


class RuleError(ValueError):
    """A rule that cannot be compiled."""


class SharedTexts:
    """Columns for the texts of fields that many rules read: each is read from raw once, and the rules refer to it by name."""

    def __init__(self) -> None:
        self.columns: dict[tuple[str, bool], str] = {}

    def column(self, name: str, cased: bool) -> Column:
        return F.col(self.columns.setdefault((name, cased), f"text_{len(self.columns)}_"))

    def added(self, events: DataFrame, raw: Column) -> DataFrame:
        """events with the columns that were asked for so far; each event is parsed once."""
        parsed, looked_up = J.with_texts(events, [name for name, _ in self.columns])
        read = lambda name: J.text(raw, name, looked_up[name])
        made = [(read(name) if cased else J.ascii_lower(read(name))).alias(c) for (name, cased), c in self.columns.items()]
        return parsed.select(*[F.col(f"`{c}`") for c in events.columns], *made)


@dataclass
class Rule:
    """A compiled rule's head and its predicate. channel and eventid are the events that it needs; empty means any."""

    id: str
    title: str
    level: str = "informational"
    status: str = ""
    description: str = ""
    author: str = ""
    tags: tuple[str, ...] = ()
    falsepositives: tuple[str, ...] = ()
    channel: tuple[str, ...] = ()
    eventid: tuple[int, ...] = ()
    name: str = ""
    detection: dict = field(default_factory=dict)
    fields_as: dict[str, str] = field(default_factory=dict)

    def predicate(self, raw: Column, lists: Callable[[str], list[str]] | None = None, nulls_match: bool = False, shared: SharedTexts | None = None) -> Column:
        return Compiler(raw, lists, self.fields_as, nulls_match, shared).detection(self.detection)


def documents(text: str) -> list[dict]:
    """The mappings of a multi-document YAML text."""
    import yaml

    return [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]


def strings(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def compile_rule(doc: dict, routed: bool = True) -> list[Rule]:
    """One Rule, or one for each route of the log source; these share the id and have titles of their own."""
    if not doc.get("title") or not isinstance(doc.get("detection"), dict):
        raise RuleError("a rule needs a title and a detection")
    if "condition" not in doc["detection"]:
        raise RuleError(f"{doc['title']}: the detection has no condition")
    level = str(doc.get("level") or "").lower()
    rule = Rule(
        str(doc.get("id") or doc["title"]), str(doc["title"]), level if level in LEVELS else "informational", str(doc.get("status") or ""), str(doc.get("description") or ""), str(doc.get("author") or ""),
        tuple(map(str, strings(doc.get("tags") or []))), tuple(map(str, strings(doc.get("falsepositives") or []))), name=str(doc.get("name") or ""), detection=doc["detection"],
    )
    source = {k: str(v or "").lower() for k, v in (doc.get("logsource") or {}).items()} if routed else {}
    # Routes are of Windows logs; a rule for another product is for all of its events.
    windows = source.get("product", "windows") in ("", "windows")
    routes = ROUTES.get(source.get("category", ""), ()) if windows else ()
    service = SERVICES.get(source.get("service", ""), ()) if windows else ()
    if service:
        routes = tuple(r for r in routes if r[0] in service)
    if not routes:
        return [replace(rule, channel=service)]
    several = len(routes) > 1
    return [replace(rule, title=f"{rule.title} ({_route_name(channel, event, routes)})" if several else rule.title, channel=(channel,), eventid=(event,), fields_as=names) for channel, event, names in routes]


def _route_name(channel: str, event: int, routes: tuple) -> str:
    """The last part of the channel's provider, with the event id if several routes share it."""
    name = channel.split("/")[0].rsplit("-", 1)[-1]
    return name if sum(c == channel for c, _, _ in routes) == 1 else f"{name} {event}"


def pattern(value: str) -> tuple[str, bool]:
    """A Sigma value as a LIKE pattern, and whether it has wildcards. A backslash escapes *, ? and itself before these."""
    out, wild, i = [], False, 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value) and value[i + 1] in "*?\\":
            i += 1
            c = value[i]
            out.append("\\" + c if c in "\\%_" else c)
        elif c in "*?":
            wild = True
            out.append("%" if c == "*" else "_")
        else:
            out.append("\\" + c if c in "\\%_" else c)
        i += 1
    return "".join(out), wild


def plain(value: str) -> str:
    """A Sigma value without its escapes."""
    return re.sub(r"\\([*?\\])", r"\1", value)


def base64_offsets(data: bytes) -> list[str]:
    """The base64 texts that data has inside longer data, at each of its three offsets."""
    out = []
    for shift in range(3):
        text = base64.b64encode(b"\x00" * shift + data).decode()
        cut = (shift + len(data)) % 3
        out.append(text[(0, 2, 3)[shift] : len(text) - (0, 3, 2)[cut]])
    return out


def _options(value: str) -> list[str]:
    """A value cut at the dashes of its options; these are at the odd places."""
    return re.split(r"(?<!\S)([-/])(?=\S)", value)


def windash(value: str) -> list[str]:
    """All variants of a value by the dash of each of its options, for values that are encoded afterwards."""
    parts = _options(value)
    return ["".join(x) for x in itertools.product(*[DASHES if i % 2 else (p,) for i, p in enumerate(parts)])]


def windash_pattern(value: str) -> str:
    """A regular expression for all variants of a value, however many options it has."""
    return "".join(f"[{''.join(DASHES)}]" if i % 2 else re.escape(p) for i, p in enumerate(_options(value)))


def ipv4_number(t: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    ok = t.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    octet = lambda i: F.split_part(t, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(ok, octet(1) * (1 << 24) + octet(2) * (1 << 16) + octet(3) * (1 << 8) + octet(4))


def ipv6_halves(t: Column) -> tuple[Column, Column]:
    """The upper and lower 64 bits of an IPv6 address; null for anything else. Its last two groups may be an IPv4 address."""
    tail = F.regexp_extract(t, r"^[0-9A-Fa-f:]*:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    four = ipv4_number(tail)
    groups = F.concat(F.hex(F.shiftright(four, 16)), F.lit(":"), F.hex(four.bitwiseAND(0xFFFF)))
    s = F.when(tail == "", t).otherwise(F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(tail)), groups))
    part = lambda i: F.filter(F.split(F.split_part(s, F.lit("::"), F.lit(i)), ":"), lambda x: x != "")
    short = F.contains(s, F.lit("::"))
    gap = F.lit(8) - F.size(part(1)) - F.when(short, F.size(part(2))).otherwise(0)
    every = F.when(short, F.concat(part(1), F.array_repeat(F.lit("0"), gap), part(2))).otherwise(part(1))
    ok = s.rlike(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::)?(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$") & F.when(short, gap >= 1).otherwise(gap == 0)
    group = lambda i: F.conv(F.get(every, F.lit(i)), 16, 10).cast("bigint")
    half = lambda i: F.shiftleft(group(i), 48).bitwiseOR(F.shiftleft(group(i + 1), 32)).bitwiseOR(F.shiftleft(group(i + 2), 16)).bitwiseOR(group(i + 3))
    return F.when(ok, half(0)), F.when(ok, half(4))


def in_networks(t: Column, networks: list[str]) -> Column:
    """Whether an address is in any of the networks: for each length of prefix that they have, one look-up in a set, however many there are."""
    by: dict[tuple[int, int], set[int]] = {}
    for n in networks:
        net = ipaddress.ip_network(n, strict=False)
        by.setdefault((net.version, net.prefixlen), set()).add(int(net.network_address) >> (net.max_prefixlen - net.prefixlen))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    four, (upper, lower) = ipv4_number(t), ipv6_halves(t)
    tests = []
    for (version, length), prefixes in sorted(by.items()):
        if version == 4:
            tests.append(F.coalesce(F.shiftright(four, 32 - length).isin(sorted(prefixes)), F.lit(False)))
        elif length <= 64:
            tests.append(F.coalesce(F.shiftrightunsigned(upper, 64 - length).isin(sorted(map(signed, prefixes))) if length else upper.isNotNull(), F.lit(False)))
        else:
            rest = length - 64
            key = F.concat_ws(":", upper.cast("string"), F.shiftrightunsigned(lower, 64 - rest).cast("string"))
            said = [f"{signed(x >> rest)}:{signed(x & (1 << rest) - 1)}" for x in sorted(prefixes)]
            tests.append(upper.isNotNull() & F.coalesce(key.isin(said), F.lit(False)))
    return F.when(t.isNotNull(), J.any_of(tests))


class Compiler:
    """Builds the Column of one detection. Texts of fields are made once each."""

    def __init__(self, raw: Column, lists: Callable[[str], list[str]] | None = None, fields_as: dict[str, str] | None = None, nulls_match: bool = False, shared: SharedTexts | None = None) -> None:
        self.raw, self.lists, self.fields_as, self.nulls_match, self.shared = raw, lists, fields_as or {}, nulls_match, shared
        self.made: dict[tuple[str, bool], Column] = {}

    def text(self, name: str, cased: bool = True) -> Column:
        name = self.fields_as.get(name, name)
        if self.shared is not None:
            return self.shared.column(name, cased)
        if (name, cased) not in self.made:
            t = J.text(self.raw, name)
            self.made[name, cased] = t if cased else J.ascii_lower(t)
        return self.made[name, cased]

    def detection(self, detection: dict) -> Column:
        searches = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}
        parts = [Conditions(str(c), searches, self).column() for c in strings(detection["condition"])]
        return J.any_of(parts)

    def search(self, body: Any) -> Column:
        if isinstance(body, dict):
            return J.all_of([self.item(k, v) for k, v in body.items()])
        if isinstance(body, list):
            return J.any_of([self.search(x) if isinstance(x, dict) else self.keyword(x) for x in body])
        return self.keyword(body)

    def keyword(self, word: Any) -> Column:
        return J.contains(self.raw, plain(str(word)))

    def item(self, key: str, value: Any) -> Column:
        name, *mods = str(key).split("|")
        if unknown := set(mods) - _KNOWN:
            raise RuleError(f"unknown modifier {sorted(unknown)[0]!r}")
        if not name:
            return (J.all_of if "all" in mods else J.any_of)([self.keyword(v) for v in strings(value)])
        if "exists" in mods:
            t = self.text(name)
            return t.isNotNull() if value in (True, "true", "True", 1) else t.isNull()
        values = strings(value)
        if "expand" in mods:
            values = self.expanded(values)
        test = self.tests(name, mods, values)
        return ~test if "neq" in mods else test

    def expanded(self, values: list) -> list:
        out: list = []
        for v in values:
            m = re.fullmatch(r"%(\w+)%", str(v))
            if not m:
                out.append(v)
                continue
            got = self.lists(m[1]) if self.lists else None
            if not got:
                raise RuleError(f"value list {m[1]!r} is unknown or empty")
            out += got
        return list(dict.fromkeys(out))

    def tests(self, name: str, mods: list[str], values: list) -> Column:
        every = "all" in mods
        join = J.all_of if every else J.any_of
        op = next((m for m in mods if m in _TEXT_MODIFIERS), None)
        if "fieldref" in mods:
            return join([self.reference(name, str(v), op, "cased" in mods) for v in values])
        if numeric := next((m for m in mods if m in _NUMERIC), None):
            t = self.text(name).try_cast("double")
            by = {"gt": t.__gt__, "gte": t.__ge__, "lt": t.__lt__, "lte": t.__le__}[numeric]
            return join([by(F.lit(float(v))) for v in values])
        if "cidr" in mods:
            networks = [str(v) for v in values]
            return J.all_of([in_networks(self.text(name), [n]) for n in networks]) if every else in_networks(self.text(name), networks)
        if "re" in mods:
            flags = "".join(m for m in mods if m in ("i", "m", "s"))
            return join([self.text(name).rlike(f"(?{flags})" * bool(flags) + str(v)) for v in values])
        cased = "cased" in mods
        encoders = [m for m in mods if m in _ENCODERS or m in ("base64", "base64offset", "windash")]
        if not encoders:
            return self.values(name, values, op, cased, every)
        if set(encoders) == {"windash"}:
            return join([self.dashed(name, plain(str(v)), op, cased) for v in values])
        return join([self.values(name, self.encoded(str(v), encoders), "contains" if "base64offset" in mods else op, cased or "base64" in mods or "base64offset" in mods, False, literal=True) for v in values])

    def dashed(self, name: str, value: str, op: str | None, cased: bool) -> Column:
        rx = windash_pattern(value if cased else value.translate(str.maketrans(J.UPPER, J.LOWER)))
        return self.text(name, cased).rlike("^" * (op in (None, "startswith")) + rx + r"\z" * (op in (None, "endswith")))

    def encoded(self, value: str, encoders: list[str]) -> list[str]:
        variants: list[str | bytes] = [plain(value)]
        for e in encoders:
            if e == "windash":
                variants = [w for v in variants for w in windash(v if isinstance(v, str) else v.decode("latin-1"))]
                continue
            data = [v if isinstance(v, bytes) else v.encode() for v in variants]
            if e in _ENCODERS:
                variants = [d.decode().encode(_ENCODERS[e]) for d in data]
            elif e == "base64":
                variants = [base64.b64encode(d).decode() for d in data]
            else:
                variants = [o for d in data for o in base64_offsets(d)]
        return [v.decode("latin-1") if isinstance(v, bytes) else v for v in variants]

    def values(self, name: str, values: list, op: str | None, cased: bool, every: bool, literal: bool = False) -> Column:
        """Tests of plain literals are one set test, or one test each for parts; only wildcards become patterns."""
        exact, rest = [], []
        t = self.text(name, cased)
        low = (lambda s: s) if cased else (lambda s: s.translate(str.maketrans(J.UPPER, J.LOWER)))
        for v in values:
            if v is None:
                rest.append(self.text(name).isNull())
                continue
            s = ("1" if v else "0") if isinstance(v, bool) else str(v)
            like, wild = (s, False) if literal else pattern(s)
            s = s if literal else plain(s)
            if wild:
                before, after = {"contains": ("%", "%"), "startswith": ("", "%"), "endswith": ("%", "")}.get(op or "", ("", ""))
                rest.append(t.like(low(before + like + after)))
            elif op:
                rest.append({"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op](t, F.lit(low(s))))
            else:
                exact.append(low(s))
        if exact and not every:
            rest.append(t.isin(exact) if len(exact) > 1 else t == exact[0])
        elif exact:
            rest += [t == e for e in exact]
        return (J.all_of if every else J.any_of)(rest)

    def reference(self, name: str, other: str, op: str | None, cased: bool) -> Column:
        a, b = self.text(name, cased), self.text(other, cased)
        return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op](a, b) if op else a == b


class Conditions:
    """A rule's condition: not binds before and, and before or; counts of selections by name patterns."""

    def __init__(self, text: str, searches: dict, compiler: Compiler) -> None:
        self.words = re.findall(r"[()]|[^\s()]+", text)
        self.at, self.searches, self.compiler = 0, searches, compiler

    def peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def next(self) -> str:
        self.at += 1
        return self.words[self.at - 1] if self.at <= len(self.words) else ""

    def column(self) -> Column:
        out = self.level("or")
        if self.peek():
            raise RuleError(f"unexpected {self.peek()!r} in the condition")
        return out

    def level(self, word: str) -> Column:
        below = (lambda: self.level("and")) if word == "or" else self.negated
        parts = [below()]
        while self.peek().lower() == word:
            self.next()
            parts.append(below())
        return (J.any_of if word == "or" else J.all_of)(parts)

    def negated(self) -> Column:
        if self.peek().lower() == "not":
            self.next()
            inner = self.negated()
            return ~F.coalesce(inner, F.lit(False)) if self.compiler.nulls_match else ~inner
        return self.single()

    def single(self) -> Column:
        word = self.next()
        if word == "(":
            inner = self.level("or")
            if self.next() != ")":
                raise RuleError("a parenthesis is not closed")
            return inner
        if self.peek().lower() == "of" and (word.isdigit() or word.lower() in ("all", "any")):
            self.next()
            return self.some(word.lower(), self.next())
        if word not in self.searches:
            raise RuleError(f"no selection {word!r}")
        return self.compiler.search(self.searches[word])

    def some(self, how: str, names: str) -> Column:
        rx = re.escape(names).replace(r"\*", ".*")
        found = [self.compiler.search(v) for k, v in self.searches.items() if (not k.startswith("_") if names == "them" else re.fullmatch(rx, k))]
        if not found:
            raise RuleError(f"no selection is named like {names!r}")
        if how == "all":
            return J.all_of(found)
        if how in ("1", "any"):
            return J.any_of(found)
        hits = [F.coalesce(c.cast("int"), F.lit(0)) for c in found]
        total = hits[0]
        for h in hits[1:]:
            total = total + h
        return total >= int(how)


def used_lists(docs: Iterable[dict]) -> set[str]:
    """Names of the value lists that rules refer to."""
    out: set[str] = set()

    def walk(node: Any, expands: bool = False) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, "expand" in str(k).split("|"))
        elif isinstance(node, list):
            for v in node:
                walk(v, expands)
        elif expands and (m := re.fullmatch(r"%(\w+)%", str(node))):
            out.add(m[1])

    for d in docs:
        walk(d.get("detection"))
    return out
