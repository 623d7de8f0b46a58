"""Window correlations against a plain evaluation of every anchor."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logwarden.functions.timespans import seconds
from logwarden.operators import correlation as C
from logwarden.plans.catalog import Correlation, in_order

T0 = datetime(2024, 1, 1)


def corr(kind, titles, span, condition=None, group_by=("u",), **more):
    return Correlation(more.pop("id", "c"), more.pop("title", "C"), kind, group_by, span, condition or {}, tuple((t, k) for t, k in titles) if titles and isinstance(titles[0], tuple) else tuple((t, "rule") for t in titles), more.pop("level", "high"))


def table(spark, rows):
    """rows: (event_id, title, batch, seconds or None, values)."""
    return spark.createDataFrame([(e, t, b, None if s is None else T0 + timedelta(seconds=s), v) for e, t, b, s, v in rows], C.LEDGER)


def subsequence(titles, steps):
    it = iter(titles)
    return all(any(x == s for x in it) for s in steps)


def brute(rows, c, met):
    out = set()
    good = [r for r in rows if r[1] in c.titles and r[3] is not None and all(r[4].get(g) is not None for g in c.group_by)]
    for e, t, b, s, v in good:
        inside = sorted((r for r in good if r[2] == b and all(r[4][g] == v[g] for g in c.group_by) and s - c.timespan <= r[3] <= s), key=lambda r: (r[3], r[0], r[1]))
        before = [r for r in inside if (r[3], r[0], r[1]) <= (s, e, t)]
        if c.kind == "event_count":
            fires = met(len(inside))
        elif c.kind == "value_count":
            fires = met(len({r[4].get(c.distinct_field) for r in inside} - {None}))
        else:
            fires = len({r[1] for r in inside}) >= len(set(c.titles))
            if c.kind == "temporal_ordered":
                fires = fires and subsequence([r[1] for r in before], c.titles)
        if fires:
            out.add((e, t))
    return out


CASES = [
    (corr("event_count", ["A"], 20, {"gte": 3}), lambda n: n >= 3),
    (corr("event_count", ["A", "B"], 20, {"gt": 1, "lt": 4}), lambda n: 1 < n < 4),
    (corr("event_count", ["A"], 10, {"lte": 2}), lambda n: n <= 2),
    (corr("event_count", ["A"], 10, {"eq": 2}), lambda n: n == 2),
    (corr("event_count", ["A"], 10, {"neq": 2}), lambda n: n != 2),
    (corr("event_count", ["A"], 10, {}), lambda n: False),
    (corr("value_count", ["A", "B"], 30, {"gte": 3, "field": "f"}), lambda n: n >= 3),
    (corr("temporal", ["A", "B", "C"], 30), None),
    (corr("temporal_ordered", ["A", "B"], 15), None),
    (corr("temporal_ordered", ["A", "B", "C"], 40), None),
    (corr("temporal_ordered", ["A", "B", "A"], 40), None),
    (corr("event_count", ["A", "B"], 25, {"gte": 2}, ("u", "w")), lambda n: n >= 2),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_every_hit_against_brute_force(spark, number):
    c, met = CASES[number]
    r = random.Random(number)
    rows = [(f"e{i:03}", r.choice("ABC"), r.choice(["x", "y"]), r.choice([None, *range(0, 120)]), {"u": r.choice(["1", "2"]), "w": r.choice(["p", "q"]), "f": r.choice("klmn")} if r.random() < 0.9 else {"w": "p"}) for i in range(90)]
    got = {(x.event_id, x.rule_title) for x in C.evaluate(table(spark, rows), c).collect()}
    assert got == brute(rows, c, met)


def test_boundaries_and_anchors(spark):
    burst = [(f"e{i}", "A", "b", 360 + i, {"u": "1"}) for i in range(9)] + [("late", "A", "b", 600, {"u": "1"})]
    c = corr("event_count", ["A"], 300, {"gte": 10})
    assert [x.n for x in C.evaluate(table(spark, burst), c).collect()] == [10]
    stale = [(f"e{i}", "A", "b", i, {"u": "1"}) for i in range(9)] + [("late", "A", "b", 600, {"u": "1"})]
    assert C.evaluate(table(spark, stale), c).collect() == []
    early = [(f"e{i}", "A", "b", i, {"u": "1"}) for i in range(10)] + [("june", "A", "b", 10**7, {"u": "1"})]
    assert C.evaluate(table(spark, early), c).count() == 1
    assert C.evaluate(table(spark, early), c, anchors="latest_in_batch").count() == 0
    new = table(spark, early).where("event_id = 'june'")
    assert C.evaluate(table(spark, early), c, new_hits=new).count() == 0
    exact = [("a", "A", "b", 0, {"u": "1"}), ("z", "A", "b", 300, {"u": "1"})]
    assert C.evaluate(table(spark, exact), corr("event_count", ["A"], 300, {"gte": 2})).count() == 1


@pytest.mark.parametrize("number", range(len(CASES)))
def test_new_hits_are_the_only_anchors(spark, number):
    """What is cut to the new hits' keys and spans gives what the whole ledger gives at these."""
    c, met = CASES[number]
    r = random.Random(50 + number)
    rows = [(f"e{i:03}", r.choice("ABC"), r.choice(["x", "y", None]), r.choice([None, *range(0, 120)]), {"u": r.choice(["1", "2", "3"]), "w": r.choice(["p", "q"]), "f": r.choice("klmn")} if r.random() < 0.9 else {"w": "p"}) for i in range(120)]
    new = {x[0] for x in rows if x[3] is not None and x[3] > 70 and r.random() < 0.3}
    got = {(x.event_id, x.rule_title) for x in C.evaluate(table(spark, rows), c, new_hits=table(spark, [x for x in rows if x[0] in new])).collect()}
    assert got == {x for x in brute(rows, c, met) if x[0] in new}
    assert C.evaluate(table(spark, rows), c, new_hits=table(spark, rows).where("false")).collect() == []


def test_reading_is_cut_to_the_window(spark, tmp_path):
    rows = [(f"e{i}", "A", "b", i * 100, {"u": str(i % 5)}) for i in range(500)]
    C_ = corr("event_count", ["A"], 600, {"gte": 1})
    table(spark, rows).write.parquet(str(tmp_path / "hits"))
    stored = spark.read.parquet(str(tmp_path / "hits"))
    df = C.evaluate(stored, C_, new_hits=table(spark, rows[-1:]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_ts" in plan and [(x.event_id, x.n) for x in df.collect()] == [("e499", 2)]


@pytest.mark.parametrize("condition, n, want", [({"gte": 2.5}, 2, False), ({"gte": 2.5}, 3, True), ({"gte": "2"}, 2, True), ({"gte": "many"}, 9, False), ({"gte": "many", "lt": 5}, 4, True), ({"field": "x"}, 4, False)])
def test_thresholds_are_numbers(spark, condition, n, want):
    assert spark.range(1).select(C.condition_met(condition, F.lit(n))).first()[0] is want


def test_distinct_values_of_a_hot_key(spark):
    """Linear in the hits: a window that holds them all."""
    r = random.Random(9)
    rows = [(f"e{i:04}", "A", "b", r.randint(0, 3000), {"u": "1", "f": None if r.random() < 0.1 else str(r.randint(0, 40))}) for i in range(1200)]
    c = corr("value_count", ["A"], 400, {"gte": 1, "field": "f"})
    got = {x.event_id: x.n for x in C.evaluate(table(spark, rows), c).collect()}
    for e, _, _, s, _ in rows[:200]:
        n = len({v["f"] for _, _, _, t, v in rows if s - 400 <= t <= s and v["f"] is not None})
        assert got.get(e, 0) == n


def test_one_key(spark):
    rows = table(spark, [(str(i), "A", "b", i, {"u": "x", "f": str(i % 3)}) for i in range(20)] + [("z", "A", "b", 5, {"u": "y"})])
    events = spark.createDataFrame([(str(i), f"raw{i}") for i in range(20)], "event_id string, raw string")
    one = lambda **k: C.key_window(rows, events, ["A"], {"u": "x"}, "b", "2024-01-01 00:00:02", "2024-01-01 00:01:00", **k).first()
    assert one().n == 18 and one().sample_events == [f"raw{i}" for i in range(2, 12)] and one(mode="distinct_values", distinct_field="f").n == 3 and one(mode="distinct_rules").n == 1
    assert C.key_window(rows, events, ["A"], {}, "b", "2024-01-01 00:00:02", "2024-01-01 00:01:00").first().n == 0


def test_chain_cycle_and_informational(spark):
    rows = [(f"e{i}", "Fail", "b", i, {"u": "1"}) for i in range(10)] + [("ok", "Success", "b", 30, {"u": "1"})]
    child = corr("event_count", ["Fail"], 300, {"gte": 10}, id="k", title="Burst")
    parent = corr("temporal_ordered", [("Burst", "correlation"), ("Success", "rule")], 300, id="p", title="Chain")
    fired, added = C.correlate(table(spark, rows), [parent, child])
    assert fired["Burst"].count() == 1 and fired["Chain"].count() == 1 and added.count() == 2
    again, _ = C.correlate(table(spark, rows), [parent, corr("event_count", ["Fail"], 300, {"gte": 10}, id="k", title="Burst", level="informational")])
    assert again["Chain"].count() == 0 and "Burst" not in again
    a = corr("temporal", [("Y", "correlation")], 10, id="a", title="X")
    b = corr("temporal", [("X", "correlation")], 10, id="b", title="Y")
    fired, added = C.correlate(table(spark, rows), [a, b])
    assert added.count() == 0 and {c.title for c in in_order([a, b])} == {"X", "Y"}


def test_hit_spec_and_window_counts(spark):
    c = corr("value_count", ["A", "B"], 60, {"gte": 2, "field": "f"})
    assert C.hit_spec([c, corr("temporal", [("C", "correlation"), ("A", "rule")], 5, group_by=("w",))]) == {"A": ["u", "f", "w"], "B": ["u", "f"]}
    rows = table(spark, [("1", "A", "b", 5, {"u": "x", "f": "p"}), ("2", "B", "b", 6, {"u": "x", "f": "p"}), ("3", "A", "b", 99, {"u": "x"}), ("4", "A", "b", 7, {})])
    one = lambda mode, f=None: [x.n for x in C.window_counts(rows, ["A", "B"], ["u"], "2024-01-01 00:00:00", "2024-01-01 00:01:00", mode, f).collect()]
    assert one("events") == [2] and one("distinct_values", "f") == [1] and one("distinct_rules") == [2]


@pytest.mark.parametrize("text, want", [("5m", 300), ("2 H", 7200), ("1M", 60), ("1w", 604800), ("3", None), ("1y", None), ("m", None), (None, None), ("-5m", None)])
def test_timespans(text, want):
    assert seconds(text) == want
