"""The index of literals against each rule's predicate."""

from __future__ import annotations

import json
import random

import pytest

from logwarden.operators import literal_index
from logwarden.operators import matching as M
from logwarden.plans.sigma import Rule

FIELDS = ("Image", "CommandLine", "User")
TEXTS = ["C:\\Tools\\App1.exe", "cmd /c whoami", "a*b", "50%_x", "ÄB", "app", "", "App1", "xAPP1.EXE.bak", "aab", "line\nbreak app1"]


def detection(r):
    def value():
        return r.choice(["app1", "APP1.exe", "*app?.exe", "c:\\\\tools\\\\*", "a\\*b", "50%_x", "äb", "who", "*", "a?b", 1, True, "aab", "k\nbr"])

    def item():
        mods = r.choice(["", "contains", "startswith", "endswith", "contains|all", "cased", "contains|cased", "neq"])
        return f"{r.choice(FIELDS)}{'|' * bool(mods)}{mods}", value() if r.random() < 0.6 else [value() for _ in range(r.randint(1, 3))]

    searches = {f"s{i}": dict(item() for _ in range(r.randint(1, 2))) if r.random() < 0.8 else [str(r.choice(["who", "app1.exe", "%"])), dict([item()])] for i in range(3)}
    return searches | {"condition": r.choice(["s0", "s0 and s1", "s0 or s1", "s0 and not s1", "s0 and not (s1 or s2)", "1 of s*", "all of them", "s0 and not 1 of s*", "not s0", "2 of s*", "(s0 or s1) and not s2"])}


@pytest.mark.parametrize("seed", range(2))
def test_rules_of_all_shapes(spark, seed):
    r = random.Random(seed)
    rules = [Rule(f"r{i}", f"R{i}", eventid=r.choice([(), (1,), (1, 2)]), channel=r.choice([(), ("Sec",)]), detection=detection(r)) for i in range(60)]
    rows = []
    for i in range(120):
        e = {f: r.choice(TEXTS) for f in FIELDS if r.random() < 0.7} | ({"Channel": r.choice(["Sec", "Sys"])} if r.random() < 0.5 else {}) | ({"User": r.choice([1, True, None, 5])} if r.random() < 0.2 else {})
        rows.append((str(i), r.choice(["1", "2", None]), json.dumps(e, ensure_ascii=False)))
    df = spark.createDataFrame(rows, "event_id string, event_code string, raw string")
    _, inside = literal_index.build(list(enumerate(rules)), None)
    assert len(inside) > 25
    shown = lambda n: {x.event_id: x.matched_rules for x in M.match(df, rules, join_literals=False, index_from=n).collect()}
    assert shown(1) == shown(10**9)


def test_what_is_not_indexed():
    rules = [Rule(str(i), str(i), detection=d) for i, d in enumerate([
        {"s": {"a|re": "x"}, "condition": "s"}, {"s": {"a": None}, "condition": "s"}, {"s": {"a": "x"}, "condition": "not s"}, {"s": {"a|contains": "*"}, "condition": "s"}, {"s": {"k|gt": 3}, "condition": "s"},
        {"s": {"a|contains": "x"}, "t": {"b|endswith": ["y", "z"]}, "condition": "s and t"}, {"s": {"a|expand": "%v%"}, "condition": "s"},
    ])]
    said, inside = literal_index.build(list(enumerate(rules)), {"v": ["p", "q"]}.get)
    assert inside == {5, 6} and len(said["units"]) >= 3


def test_shared_units_and_wildcards_cost_few_tries():
    """Rules that share a unit are not all tried when it holds, and a wildcard's literal keeps its escaped backslash."""
    detections = [{"s": {"Image|contains|all": ["tools", f"app{i}.exe"]}, "t": {"Host|endswith": ["-7", "-3"]}, "u": {"Path": f"*\\app{i}.e?e"}, "condition": "s and t and u"} for i in range(300)]
    said, inside = literal_index.build([(i, Rule(str(i), str(i), detection=d)) for i, d in enumerate(detections)], None)
    index = literal_index.Index(said)
    assert len(inside) == 300 and max(map(len, index.led_by.values())) == 1
    assert literal_index.literal_chunks("%\\\\app1.e_e%") == ["\\app1.e", "e"]
    path = next(a for (f, _), a in zip(index.fields, index.automata, strict=True) if f == "Path")
    assert max(len(tests) for _, tests in path.iter("c:\\tools\\app12.exe")) == 1
    texts = {"Host": "h-3", "Image": "c:\\tools\\app12.exe", "Path": "c:\\x\\app12.exe"}
    for _ in range(2):
        assert index.rules_of([texts[f] for f, _ in index.fields], None, None) == [12]


def test_counted_selections_are_columns():
    said, inside = literal_index.build([(0, Rule("a", "a", detection={"s0": {"a": "x"}, "s1": {"b": "y"}, "condition": "2 of s*"})), (1, Rule("b", "b", detection={"s": {"a": "x"}, "condition": "s"}))], None)
    assert inside == {1}
