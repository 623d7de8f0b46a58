"""The analysts' filter language, from text to a Column.

    severity = high and (host contains web or not user in (root, "svc app"))

Words bind as or < and < not; keywords are case-insensitive. Parsing is a
precedence climb over one list of tokens and yields a small tree; compiling
walks the tree and builds Columns. User text is only ever a literal.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsontext as J

#: Operator names by their signs, and words that stand for booleans.
SIGNS = {"=": "eq", "!=": "neq", "<>": "neq", ">": "gt", "<": "lt", ">=": "gte", "<=": "lte"}
OPERATORS = frozenset({*SIGNS.values(), "contains", "in", "isnull", "notnull"})
TRUE_WORDS = frozenset({"true", "1", "yes", "да"})
FALSE_WORDS = frozenset({"false", "0", "no", "нет"})

#: Fixed by the grammar: quoted texts with escapes, signs, marks, and words of all other characters.
_SCANNER = re.compile(r"""\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<sign>[<>!]=|<>|[=<>])|(?P<mark>[(),])|(?P<word>[^\s()=<>!,"']+))""", re.DOTALL)


class FilterError(ValueError):
    """A filter that cannot be read; the message tells the position, from 1."""


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str | list[str] | None = None


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Join:
    word: str
    parts: tuple


@dataclass(frozen=True)
class _Item:
    kind: str
    value: str
    at: int

    @property
    def key(self) -> str:
        return self.value.lower() if self.kind == "word" else ""


def scan(text: str) -> list[_Item]:
    items, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = _SCANNER.match(text, at)
        if not m:
            where = at + len(text[at:]) - len(text[at:].lstrip())
            raise FilterError(f"position {where + 1}: {text[where]!r} begins no word, quoted text or sign")
        kind = m.lastgroup
        value = m[kind]
        start = m.start(kind) + 1
        if kind == "quoted":
            q = value[0]
            value = re.sub(rf"\\([\\{q}])", r"\1", value[1:-1])
        items.append(_Item(kind, value, start))
        at = m.end()
    return [*items, _Item("end", "", len(text) + 1)]


class _Reader:
    """A cursor over the items."""

    def __init__(self, items: list[_Item]) -> None:
        self.items, self.i = items, 0

    @property
    def now(self) -> _Item:
        return self.items[self.i]

    def take(self, kind: str, what: str, values: tuple[str, ...] = ()) -> _Item:
        item = self.now
        if item.kind != kind or (values and (item.key or item.value) not in values):
            raise FilterError(f"position {item.at}: {item.value or 'the end'!r} stands where {what} should be")
        self.i += 1
        return item

    def skip(self, *words: str) -> bool:
        if self.now.key in words and self.now.kind == "word":
            self.i += 1
            return True
        return False

    def value(self) -> str:
        if self.now.kind not in ("word", "quoted"):
            raise FilterError(f"position {self.now.at}: {self.now.value or 'the end'!r} stands where a value should be")
        self.i += 1
        return self.items[self.i - 1].value


_LEVELS = ("or", "and")


def _joined(r: _Reader, level: int = 0):
    if level == len(_LEVELS):
        return Not(_joined(r, level)) if r.skip("not") else _single(r)
    parts = [_joined(r, level + 1)]
    while r.skip(_LEVELS[level]):
        parts.append(_joined(r, level + 1))
    return parts[0] if len(parts) == 1 else Join(_LEVELS[level], tuple(parts))


def _single(r: _Reader):
    if r.now.value == "(" and r.now.kind == "mark":
        r.i += 1
        inner = _joined(r)
        r.take("mark", "')'", (")",))
        return inner
    if r.now.key in (*_LEVELS, "not"):
        raise FilterError(f"position {r.now.at}: {r.now.value!r} stands where a field should be")
    field = r.take("word", "a field").value
    if r.skip("is"):
        op = "notnull" if r.skip("not") else "isnull"
        r.take("word", "'null'", ("null",))
        return Condition(field, op)
    if r.skip("in"):
        r.take("mark", "'('", ("(",))
        values = [r.value()]
        while r.now.value == "," and r.now.kind == "mark":
            r.i += 1
            values.append(r.value())
        r.take("mark", "')'", (")",))
        return Condition(field, "in", values)
    if r.skip("contains"):
        return Condition(field, "contains", r.value())
    sign = r.take("sign", "an operator")
    return Condition(field, SIGNS[sign.value], r.value())


def parse(text: str):
    """The tree of a filter, or None if it is blank."""
    items = scan(text or "")
    if len(items) == 1:
        return None
    r = _Reader(items)
    tree = _joined(r)
    r.take("end", "the end")
    return tree


def as_number(value: str) -> float | None:
    """A literal as a number, or None. Underscores, inf and nan are read as Python reads them."""
    try:
        return float(value)
    except ValueError:
        return None


def _compare(left: Column, op: str, right: Column) -> Column:
    return {"gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right}[op]


def values_of(value) -> list[str]:
    """The values of in: a list, or a text with commas."""
    parts = value.split(",") if isinstance(value, str) else list(value or [])
    return [str(p).strip() if isinstance(value, str) else str(p) for p in parts if str(p).strip() or not isinstance(value, str)]


def text_condition(t: Column, op: str, value) -> Column:
    """A condition on a text column."""
    if op == "isnull":
        return t.isNull()
    if op == "notnull":
        return t.isNotNull()
    if op == "in":
        values = values_of(value)
        return t.isin(values) if values else F.lit(False)
    value = "" if value is None else str(value)
    if op == "eq":
        return t == value
    if op == "neq":
        return t.isNull() | (t != value)
    if op == "contains":
        return J.contains(t, value)
    if op in ("gt", "lt", "gte", "lte"):
        n = as_number(value)
        if n is None:
            return _compare(t, op, F.lit(value))
        return F.lit(None).cast("boolean") if math.isnan(n) else _compare(J.number(t), op, F.lit(n))
    raise FilterError(f"unknown operator {op!r}")


def matched_condition(op: str, value) -> Column:
    """is_matched = / !=."""
    word = str(value).strip().lower()
    if op not in ("eq", "neq") or word not in TRUE_WORDS | FALSE_WORDS:
        raise FilterError("is_matched takes = or != and true or false")
    want = (word in TRUE_WORDS) == (op == "eq")
    return F.col("is_matched") == want


def rule_condition(op: str, value) -> Column:
    """Conditions on the titles of an event's matched rules, or, by > and the like, on their number."""
    titles = F.coalesce(F.col("matched_rules"), F.array().cast("array<string>"))
    if op in ("isnull", "notnull"):
        return F.col("is_matched") == (op == "notnull")
    if op == "eq":
        return F.array_contains(titles, str(value))
    if op == "neq":
        return ~F.array_contains(titles, str(value))
    if op == "contains":
        return F.exists(titles, lambda t: J.contains(t, str(value)))
    if op == "in":
        values = values_of(value)
        return F.arrays_overlap(titles, F.array(*[F.lit(v) for v in values])) if values else F.lit(False)
    n = as_number(str(value))
    if op not in ("gt", "lt", "gte", "lte") or n is None:
        raise FilterError(f"rule can't be compared by {op} with {value!r}")
    return _compare(F.size(titles).cast("double"), op, F.lit(n))


def condition(c: Condition, text_of: Callable[[str], Column]) -> Column:
    """text_of gives the text column of a field of the event."""
    name = c.field.lower()
    if name == "is_matched":
        return matched_condition(c.op, c.value)
    if name == "rule":
        return rule_condition(c.op, c.value)
    if c.op not in OPERATORS:
        raise FilterError(f"unknown operator {c.op!r}")
    return text_condition(text_of(c.field), c.op, c.value)


def fields_of(tree) -> list[str]:
    """The fields of events that a filter reads, each once."""
    if isinstance(tree, Condition):
        return [] if tree.field.lower() in ("is_matched", "rule") else [tree.field]
    parts = [tree.part] if isinstance(tree, Not) else tree.parts
    return list(dict.fromkeys(f for p in parts for f in fields_of(p)))


def _compiled(tree, text_of: Callable[[str], Column]) -> Column:
    if isinstance(tree, Condition):
        return condition(tree, text_of)
    if isinstance(tree, Not):
        return ~_compiled(tree.part, text_of)
    parts = [_compiled(p, text_of) for p in tree.parts]
    return J.any_of(parts) if tree.word == "or" else J.all_of(parts)


def compile_tree(tree, raw: Column | None = None, promoted: dict[str, Column] | None = None) -> Column:
    """promoted: text columns by field name, to be read in place of raw. Conditions on these alone reach the file scan.

    All others read each of their fields once an event, however often a filter
    names it.
    """
    known = promoted or {}
    parts = tree.parts if isinstance(tree, Join) and tree.word == "and" else [tree]
    plain = [p for p in parts if set(fields_of(p)) <= set(known)]
    rest = [p for p in parts if p not in plain]
    made = [_compiled(p, known.__getitem__) for p in plain]
    if rest:
        fields = [f for f in dict.fromkeys(f for p in rest for f in fields_of(p)) if f not in known]
        made.append(J.with_looked_up(F.col("raw") if raw is None else raw, fields, lambda found: J.all_of([_compiled(p, lambda f: known[f] if f in known else found[f]) for p in rest])))
    return J.all_of(made)


def compile_filter(text: str, raw: Column | None = None, promoted: dict[str, Column] | None = None) -> Column | None:
    """The Column of a filter; None for a blank one."""
    tree = parse(text)
    return None if tree is None else compile_tree(tree, raw, promoted)


def drill_in(conditions: list[dict], raw: Column | None = None) -> Column:
    """All of several {field, op, value}; those without a field, or with an unknown operator, are passed over."""
    parts = []
    for c in conditions:
        field, op = str(c.get("field") or "").strip(), c.get("op") or "eq"
        if field and op in OPERATORS:
            parts.append(Condition(field, op, c.get("value")))
    return compile_tree(Join("and", tuple(parts)), raw) if parts else J.all_of([])
