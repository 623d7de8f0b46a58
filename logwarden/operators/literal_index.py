"""An index of the literals of many rules, for rules of any shape that test texts.

A rule's condition becomes alternatives; each is a set of units that must hold
and of units that must not. A unit is what one item of a selection asks: that a
field equals, contains, begins or ends with one of some literals, or fits a
pattern. All literals of a field are one Aho-Corasick automaton, so an
event's text is read once, whatever the number of rules, and texts that come
again are not read again. An alternative is tried only if its rarest unit, the
one that fewest alternatives ask for, holds: then its other units decide. So
work follows an event's text and its hits, not the rules, however many
of these share a common unit.

A unit of a missing field neither holds nor may be negated, as in SQL.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..plans.sigma import Compiler, Rule, RuleError, SharedTexts, pattern, plain, strings

#: Alternatives of a rule's condition up to this number are indexed.
MOST_ALTERNATIVES = 64
#: Texts of a field, up to this length and number, whose units a task keeps.
KEPT_LENGTH, KEPT_TEXTS = 256, 10_000
_LOW = str.maketrans(J.UPPER, J.LOWER)


class Unindexed(RuleError):
    """A rule that tests something other than texts, or has too many alternatives."""


class Formula:
    """Alternatives of (unit, whether it must hold)."""

    def __init__(self, terms: frozenset[frozenset[tuple[int, bool]]]) -> None:
        if len(terms) > MOST_ALTERNATIVES:
            raise Unindexed("too many alternatives")
        self.terms = terms

    def __and__(self, other: Formula) -> Formula:
        if len(self.terms) * len(other.terms) > 4 * MOST_ALTERNATIVES:
            raise Unindexed("too many alternatives")
        return Formula(frozenset(a | b for a in self.terms for b in other.terms))

    def __or__(self, other: Formula) -> Formula:
        return Formula(self.terms | other.terms)

    def __invert__(self) -> Formula:
        out = Formula(frozenset([frozenset()]))
        for term in self.terms:
            out = out & Formula(frozenset(frozenset([(u, not yes)]) for u, yes in term))
        return out

    def cast(self, kind: str) -> Formula:
        """Selections that are counted, as in 2 of them, are none of a missing field, and may be negated then: columns do that."""
        raise Unindexed("a number of selections")


def like_regex(like: str) -> str:
    """A LIKE pattern as a regular expression."""
    parts = re.findall(r"\\.|.", like, re.S)
    return "".join(".*" if p == "%" else "." if p == "_" else re.escape(p[-1]) for p in parts)


def literal_chunks(like: str) -> list[str]:
    """The texts between the wildcards of a LIKE pattern, as they are without escapes."""
    chunks = [""]
    for p in re.findall(r"\\.|.", like, re.S):
        if p in "%_":
            chunks.append("")
        else:
            chunks[-1] += p[-1]
    return [c for c in chunks if c]


class Units(Compiler):
    """Compiles detections to formulas over units, which it numbers."""

    def __init__(self, lists: Callable[[str], list[str] | None] | None) -> None:
        super().__init__(None, lists)
        self.known: dict[tuple, int] = {}

    def of(self, rule: Rule) -> Formula:
        self.fields_as = rule.fields_as
        out = self.detection(rule.detection)
        if not isinstance(out, Formula) or any(not any(yes for _, yes in term) for term in out.terms):
            raise Unindexed("an alternative asks for nothing")
        return out

    def unit(self, field: str, cased: bool, tests: list[tuple]) -> Formula:
        number = self.known.setdefault((field, cased, tuple(tests)), len(self.known))
        return Formula(frozenset([frozenset([(number, True)])]))

    def keyword(self, word) -> Formula:
        literal = plain(str(word)).translate(_LOW)
        if not literal:
            raise Unindexed("an empty keyword")
        return self.unit("", False, [("contains", literal, None)])

    def item(self, key: str, value) -> Formula:
        name, *mods = str(key).split("|")
        if not name:
            parts = [self.keyword(v) for v in strings(value)]
            return (J.all_of if "all" in mods else J.any_of)(parts)
        if set(mods) - {"contains", "startswith", "endswith", "all", "cased", "expand", "neq"}:
            raise Unindexed("another test")
        values = self.expanded(strings(value)) if "expand" in mods else strings(value)
        op = next((m for m in mods if m in ("contains", "startswith", "endswith")), "equals")
        tests = [self.text_test(v, op, "cased" in mods) for v in values]
        field = self.fields_as.get(name, name)
        groups = [[t] for t in tests] if "all" in mods else [tests]
        out = J.all_of([self.unit(field, "cased" in mods, g) for g in groups])
        return ~out if "neq" in mods else out

    @staticmethod
    def text_test(value, op: str, cased: bool) -> tuple[str, str, str | None]:
        """(op, literal to look for, pattern that decides, if there are wildcards)."""
        if value is None or value == "":
            raise Unindexed("no literal")
        said = ("1" if value else "0") if isinstance(value, bool) else str(value)
        low = (lambda s: s) if cased else (lambda s: s.translate(_LOW))
        like, wild = pattern(said)
        if not wild:
            return op, low(plain(said)), None
        before, after = {"contains": ("%", "%"), "startswith": ("", "%"), "endswith": ("%", "")}.get(op, ("", ""))
        chunks = literal_chunks(like)
        if not chunks:
            raise Unindexed("only wildcards")
        return "pattern", low(max(chunks, key=len)), like_regex(low(before + like + after))


def build(rules: list[tuple[int, Rule]], lists: Callable[[str], list[str] | None] | None) -> tuple[dict, set[int]]:
    """What the function on executors needs, and the numbers of the rules that are in it."""
    units, terms, inside = Units(lists), [], set()
    for i, rule in rules:
        try:
            formula = units.of(rule)
        except Unindexed:
            continue
        inside.add(i)
        for term in formula.terms:
            terms.append((i, sorted(u for u, yes in term if yes), sorted(u for u, yes in term if not yes), [str(e) for e in rule.eventid], list(rule.channel)))
    return {"units": list(units.known), "terms": terms}, inside if find_spec("ahocorasick") else set()


class Index:
    """The automata and counters of an index, as tasks use them."""

    def __init__(self, said: dict) -> None:
        import ahocorasick

        self.fields = sorted({(f, cased) for f, cased, _ in said["units"]})
        at = {k: i for i, k in enumerate(self.fields)}
        words: list[dict[str, list]] = [defaultdict(list) for _ in self.fields]
        self.field_of = [at[f, cased] for f, cased, _ in said["units"]]
        for u, (f, cased, tests) in enumerate(said["units"]):
            for op, literal, rx in tests:
                words[at[f, cased]][literal].append((op, len(literal), u, re.compile(rx, re.S) if rx else None))
        self.automata = []
        for known in words:
            a = ahocorasick.Automaton()
            for literal, tests in known.items():
                a.add_word(literal, tests)
            a.make_automaton()
            self.automata.append(a)
        terms = said["terms"]
        asking = Counter(u for _, yes, *_ in terms for u in yes)
        self.led_by: dict[int, list[tuple]] = defaultdict(list)
        for rule, yes, no, codes, channels in terms:
            lead = min(yes, key=lambda u: (asking[u], u))
            self.led_by[lead].append((rule, [u for u in yes if u != lead], no, codes, channels))
        self.seen: list[dict[str, frozenset[int]]] = [{} for _ in self.fields]

    @staticmethod
    def read(automaton, text: str) -> frozenset[int]:
        """The units of a field that hold for its text."""
        out: set[int] = set()
        for end, tests in automaton.iter(text):
            for op, n, u, rx in tests:
                if u in out:
                    continue
                if op == "contains" or (op == "startswith" and end == n - 1) or (op == "endswith" and end == len(text) - 1) or (op == "equals" and n == len(text)) or (op == "pattern" and rx.fullmatch(text)):
                    out.add(u)
        return frozenset(out)

    def units_of(self, texts: list) -> set[int]:
        """The units that hold for the texts of the fields."""
        out: set[int] = set()
        for (field, _), a, seen, text in zip(self.fields, self.automata, self.seen, texts, strict=True):
            if text is None:
                continue
            found = seen.get(text)
            if found is None:
                found = self.read(a, text)
                # Whole events hardly come again.
                if field and len(text) <= KEPT_LENGTH:
                    if len(seen) >= KEPT_TEXTS:
                        seen.clear()
                    seen[text] = found
            out |= found
        return out

    def rules_of(self, texts: list, code: str | None, channel: str | None) -> list[int]:
        hold = self.units_of(texts)
        out: set[int] = set()
        for lead in self.led_by.keys() & hold:
            for rule, rest, no, codes, channels in self.led_by[lead]:
                if not hold.issuperset(rest) or any(x in hold or texts[self.field_of[x]] is None for x in no) or (codes and code not in codes) or (channels and channel is not None and channel not in channels):
                    continue
                out.add(rule)
        return sorted(out)


_MADE: dict[int, Index] = {}


def numbers(said: dict, raw: Column, shared: SharedTexts) -> Column:
    """The numbers of the indexed rules that match an event; with a column event_code."""
    key = hash(json.dumps(said, sort_keys=True, default=str))
    fields = sorted({(f, cased) for f, cased, _ in said["units"]})

    @F.pandas_udf("array<int>")
    def found(*columns):
        import pandas as pd

        from logwarden.operators import literal_index as here

        if key not in here._MADE:
            here._MADE.clear()
            here._MADE[key] = Index(said)
        index = here._MADE[key]
        lists = [c.astype("object").where(c.notna(), None).tolist() for c in columns]
        return pd.Series([index.rules_of(list(texts), code, channel) for code, channel, *texts in zip(*lists, strict=True)])

    texts = [J.ascii_lower(raw) if f == "" else shared.column(f, cased) for f, cased in fields]
    return found(F.col("event_code"), shared.column("Channel", True), *texts)
