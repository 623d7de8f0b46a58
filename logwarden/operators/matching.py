"""Rule packs over events.

Rules are routed by the event ids that they need, so an event is tested by
the rules of its id and by those that need none; each route is a branch of
one projection, and large routes are cut into packs, so no expression grows
with the number of rules. Rules that only list literals of one field are
joined instead: the last path component of the field is looked up in a table
of all their literals. What is carried along are the rules' numbers; their
heads are looked up in one literal at the end.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..plans.sigma import Rule, SharedTexts, pattern, plain, strings
from . import literal_index

PACK = 100
MATCH = "struct<id:string,title:string,level:string,tags:array<string>>"
CANDIDATE = "struct<whole:boolean,literal:string,rule:int,codes:array<string>>"
#: Rules, besides those that are joined, from which on they are found by an index.
INDEX_FROM = 200
#: Literals of a field up to this number are broadcast; beyond it the join shuffles.
BROADCAST_LITERALS = 100_000


def heads(rules: list[Rule]) -> Column:
    """One literal: the heads of all rules, by their numbers."""
    said = [{"id": r.id, "title": r.title, "level": r.level, "tags": list(r.tags)} for r in rules]
    return F.from_json(F.lit(json.dumps(said)), f"array<{MATCH}>")


def routes(rules: Iterable[tuple[int, Rule]]) -> dict[int | None, list[tuple[int, Rule]]]:
    """Numbered rules by each event id that they need; None for those that need none."""
    out: dict[int | None, list[tuple[int, Rule]]] = defaultdict(list)
    for i, r in rules:
        for e in dict.fromkeys(r.eventid) or (None,):
            out[e].append((i, r))
    return dict(out)


def _numbers(rules: list[tuple[int, Rule]], raw: Column, lists: Callable | None, shared: SharedTexts) -> Column:
    """The numbers of the rules that match."""
    tests = []
    for i, r in rules:
        p = r.predicate(raw, lists, shared=shared)
        if r.channel:
            c = shared.column("Channel", True)
            p = (c.isNull() | c.isin(list(r.channel))) & p
        tests.append(F.when(p, F.lit(i)))
    return F.array_compact(F.array(*tests))


def match(events: DataFrame, rules: Iterable[Rule], lists: Callable[[str], list[str] | None] | None = None, pack: int = PACK, join_literals: bool = True, index_from: int = INDEX_FROM) -> DataFrame:
    """Events with matched (array of id, title, level, tags, in the order of the rules), matched_rules (titles) and is_matched.

    A missing Channel does not rule an event out. events: raw, and event_code.
    Each event is parsed once. Rules that list literals of one field are found
    by a join for each such field (not with join_literals off); no event is
    shuffled for it while the literals may be broadcast. From index_from other
    rules on, those that test texts are found by an index of their literals.
    """
    rules = list(rules)
    raw, none, columns = F.col("raw"), F.array().cast("array<int>"), [c for c in events.columns if c not in ("matched", "matched_rules", "is_matched")]
    shared = SharedTexts()
    literal = {i: literal_rows(r) for i, r in enumerate(rules) if join_literals and not r.channel}
    tables: dict[str, dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    for i, found in literal.items():
        for f, op, v in found or ():
            tables[f][base_of(v)].append((op == "equals", v, i, [str(e) for e in rules[i].eventid]))
    parts: list[Column] = []
    others = [(i, r) for i, r in enumerate(rules) if literal.get(i) is None]
    if len(others) >= index_from:
        said, inside = literal_index.build(others, lists)
        if inside:
            parts.append(literal_index.numbers(said, raw, shared))
            others = [(i, r) for i, r in others if i not in inside]
    for event, some in routes(others).items():
        for i in range(0, len(some), pack):
            found = _numbers(some[i : i + pack], raw, lists, shared)
            parts.append(found if event is None else F.when(F.col("event_code") == str(event), found).otherwise(none))
    values = {f: shared.column(f, False) for f in sorted(tables)}
    out = shared.added(events, raw) if parts or tables else events
    for k, (f, bases) in enumerate(sorted(tables.items())):
        table = events.sparkSession.createDataFrame(list(bases.items()), f"base_{k}_ string, found_{k}_ array<{CANDIDATE}>")
        small = sum(map(len, bases.values())) <= BROADCAST_LITERALS
        out = out.join(F.broadcast(table) if small else table, last_component(values[f]) == F.col(f"base_{k}_"), "left")
        parts.append(_hits(F.col(f"found_{k}_"), values[f]))
    numbers = F.array_sort(F.concat(*parts)) if parts else none
    out = out.withColumn("numbers_", numbers).select(*[F.col(f"`{c}`") for c in columns], "numbers_")
    said = heads(rules)
    out = out.withColumn("matched", F.transform("numbers_", lambda n: F.get(said, n)).cast(f"array<{MATCH}>") if rules else F.array().cast(f"array<{MATCH}>"))
    return out.withColumn("matched_rules", F.col("matched.title")).withColumn("is_matched", F.size("numbers_") > 0).drop("numbers_")


def _hits(found: Column, value: Column) -> Column:
    """The numbers of the candidates whose literal the value is, or ends with, and whose event ids have the event's."""

    def holds(c):
        code = (F.size(c["codes"]) == 0) | F.array_contains(c["codes"], F.coalesce("event_code", F.lit("")))
        return F.when(c["whole"], value == c["literal"]).otherwise(F.endswith(value, c["literal"])) & code

    numbers = F.transform(F.filter(found, holds), lambda c: c["rule"])
    return F.coalesce(F.array_distinct(numbers), F.array().cast("array<int>"))


def literal_rows(rule: Rule) -> list[tuple[str, str, str]] | None:
    """(field, op, literal in lower case) if the rule is one selection of plain literals of one field by equality or endswith; else None."""
    searches = {k: v for k, v in rule.detection.items() if k not in ("condition", "timeframe")}
    if len(searches) != 1 or strings(rule.detection["condition"]) != [next(iter(searches))]:
        return None
    body = next(iter(searches.values()))
    if not isinstance(body, dict) or len(body) != 1:
        return None
    key, value = next(iter(body.items()))
    name, *mods = str(key).split("|")
    if mods not in ([], ["endswith"]) or not name:
        return None
    low = []
    for v in strings(value):
        if v is None or v == "":
            return None
        s = ("1" if v else "0") if isinstance(v, bool) else str(v)
        if pattern(s)[1]:
            return None
        low.append(plain(s).translate(str.maketrans(J.UPPER, J.LOWER)))
    # An ending joins on the last component only if it holds a whole one.
    if mods and not all("\\" in v or "/" in v for v in low):
        return None
    return [(rule.fields_as.get(name, name), mods[0] if mods else "equals", v) for v in low]


def base_of(literal: str) -> str:
    return literal.replace("\\", "/").rsplit("/", 1)[-1]


def last_component(c: Column) -> Column:
    """What is behind the last slash or backslash."""
    return F.substring_index(F.translate(c, "\\", "/"), "/", -1)


def match_literals(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(event_id, id, title, level, tags) of the rules of literal_rows(); each event and rule once."""
    found = match(events, [r for r in rules if literal_rows(r) is not None])
    return found.select("event_id", F.explode("matched").alias("m")).select("event_id", "m.*")


def matches(matched: DataFrame) -> DataFrame:
    """One row per event and matched rule."""
    return matched.select("*", F.explode("matched").alias("m")).select(*[c for c in matched.columns if c != "matched"], F.col("m.id").alias("rule_id"), F.col("m.title").alias("rule_title"), F.col("m.level").alias("rule_level"), F.col("m.tags").alias("tags"))


def in_values(events: DataFrame, field: str, values: DataFrame) -> DataFrame:
    """Events whose field is one of a table's values (column value), for lists that are too long for an expression."""
    v = values.select(J.ascii_lower(F.col("value")).alias("v_")).distinct()
    return events.withColumn("v_", J.ascii_lower(J.text(F.col("raw"), field))).join(v, "v_", "left_semi").drop("v_")
