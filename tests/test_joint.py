"""Many correlations in one pass against each by itself."""

from __future__ import annotations

import random

import pytest

from logwarden.operators import correlation as C
from logwarden.operators import joint
from logwarden.plans.catalog import Correlation

from .test_correlation import CASES, brute, corr, table


def many(r, n=30):
    kinds = ("event_count", "value_count", "temporal", "temporal_ordered")
    out = []
    for i in range(n):
        kind = r.choice(kinds)
        titles = [r.choice("ABC") for _ in range(r.randint(1, 4))] if kind == "temporal_ordered" else r.sample("ABC", r.randint(1, 3))
        condition = {r.choice(["gte", "gt", "lte", "lt", "eq", "neq"]): r.choice([1, 2, 3, "2", 2.5, "x"]) for _ in range(r.randint(1, 2))} if "count" in kind else r.choice([{}, {}, {"gte": 2}])
        out.append(corr(kind, titles, r.choice([5, 20, 60]), condition | ({"field": "f"} if kind == "value_count" else {}), r.choice([("u",), ("w",), ("u", "w")]), id=f"c{i}", title=f"C{i}"))
    return out


def ledger_rows(r, n=150, times=120):
    return [(f"e{i:03}", r.choice("ABC"), r.choice(["x", "y", None]), r.choice([None, *range(0, times)]), {"u": r.choice("123"), "w": r.choice("pq"), **({"f": r.choice("klmn")} if r.random() < 0.8 else {})} if r.random() < 0.9 else {"w": "p"}) for i in range(n)]


def shown(fired, correlations):
    return sorted((correlations[x.rule].title, x.event_id, x.rule_title, x.n, str(x.source_batch), tuple(x["keys"])) for x in fired.collect())


def one_by_one(hits, correlations, **options):
    out = []
    for c in correlations:
        for x in C.evaluate(hits, c, **options).collect():
            out.append((c.title, x.event_id, x.rule_title, x.n, str(x.source_batch), tuple(x[f"k{i}"] for i in range(len(c.group_by)))))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"anchors": "latest_in_batch"}, {"final_step_only": True}])
def test_same_rows_as_one_by_one(spark, options):
    r = random.Random(len(options))
    correlations, hits = many(r, 16), table(spark, ledger_rows(r)).cache()
    assert shown(joint.evaluate_all(hits, correlations, **options), correlations) == one_by_one(hits, correlations, **options)


def test_against_brute_force(spark):
    r = random.Random(7)
    rows = ledger_rows(r)
    correlations = [Correlation(f"c{i}", f"C{i}", c.kind, c.group_by, c.timespan, c.condition, c.base_rules, "high") for i, (c, _) in enumerate(CASES)]
    got = joint.evaluate_all(table(spark, rows), correlations).collect()
    for i, (c, met) in enumerate(CASES):
        assert {(x.event_id, x.rule_title) for x in got if x.rule == i} == brute(rows, c, met)


@pytest.mark.parametrize("anchors", ["every_hit", "latest_in_batch"])
def test_new_hits(spark, anchors):
    r = random.Random(3)
    rows = ledger_rows(r)
    correlations, hits = many(r, 12), table(spark, rows).cache()
    new = table(spark, [x for x in rows if x[3] is not None and x[3] > 70 and r.random() < 0.3]).cache()
    assert shown(joint.evaluate_all(hits, correlations, anchors, new, late=False), correlations) == one_by_one(hits, correlations, anchors=anchors, new_hits=new)
    assert joint.evaluate_all(hits, correlations, anchors, new.where("false")).collect() == [] == joint.evaluate_all(hits, []).collect()


@pytest.mark.parametrize("seed", range(2))
def test_any_order_of_arrival_fires_what_the_batch_fires(spark, seed):
    """Counts that only rise: what fires over all arrivals, in any order, is what fires at once, the levels above included."""
    r = random.Random(seed)
    rows = ledger_rows(r, 100)
    base = [c for c in many(r, 30) if set(c.condition) <= {"gte", "gt", "field"}][:8]
    parents = [Correlation("p0", "P0", "temporal", ("u",), 60, {}, ((base[0].title, "correlation"), ("A", "rule")), "high"), Correlation("p1", "P1", "event_count", base[1].group_by, 60, {"gte": 2}, ((base[1].title, "correlation"),), "high")]
    base[0] = Correlation("b0", base[0].title, "event_count", ("u",), 20, {"gte": 2}, (("A", "rule"), ("B", "rule")), "high")
    correlations = [*parents, *base]
    key = lambda df: sorted({(x.event_id, x.rule_title, str(x.source_batch), str(x.event_ts)) for x in df.collect()})
    _, added = joint.correlate_all(table(spark, rows), correlations)
    want = key(added)
    r.shuffle(rows)
    stored, synthetic = [], []
    for i in range(0, len(rows), 34):
        new = rows[i : i + 34]
        stored += new
        hits = table(spark, stored).unionByName(spark.createDataFrame(synthetic, C.LEDGER))
        _, added = joint.correlate_all(hits, correlations, new_hits=table(spark, new), keep=lambda df, _: df.cache())
        synthetic = list({(x.event_id, x.source_batch): x for x in [*synthetic, *added.collect()]}.values())
    assert key(spark.createDataFrame(synthetic, C.LEDGER)) == want and len(want) > 20


def test_alerts_are_those_of_each(spark):
    r = random.Random(5)
    rows = ledger_rows(r, 120)
    correlations, hits = many(r, 10), table(spark, rows).cache()
    events = spark.createDataFrame([(e, f"h{i % 5}", f"u{i % 3}", None, None, "p", f"raw{i}") for i, (e, *_) in enumerate(rows)], "event_id string, host string, user_name string, src_ip string, dst_ip string, process string, raw string").join(hits.select("event_id", "event_ts"), "event_id").cache()
    names = ["dedup_key", "engine", "source_batch", "host", "rule_id", "rule_title", "rule_level", "event_count", "entities", "sample_events", "event_ts"]
    got = sorted(map(str, joint.alerts_of(joint.evaluate_all(hits, correlations).cache(), correlations, hits, events).select(*names).collect()))
    want = [x for c in correlations for x in C.fired_alerts(C.evaluate(hits, c).where("source_batch is not null"), c, hits, events).select(*names).collect()]
    assert [x for x in got if "source_batch=None" not in x] == sorted(map(str, want)) and len(want) > 10


def test_later_anchors_stand(spark):
    """A late hit that fires an old anchor doesn't replace the alert of a later one."""
    c = corr("event_count", ["A"], 10, {"gte": 2}, id="k", title="K")
    rows = [("a", "A", "b", 0, {"u": "1"}), ("b", "A", "b", 5, {"u": "1"}), ("y", "A", "b", 100, {"u": "1"}), ("z", "A", "b", 101, {"u": "1"})]
    hits = table(spark, rows)
    fired = joint.evaluate_all(hits, [c], new_hits=hits.where("event_id = 'a'"))
    assert [x.event_id for x in fired.collect()] == ["b"]
    events = spark.createDataFrame([], "event_id string, host string, user_name string, src_ip string, dst_ip string, process string, raw string, event_ts timestamp_ntz")
    stored = joint.own_hits(joint.evaluate_all(hits.where("event_id in ('y', 'z')"), [c]), [c])
    assert joint.alerts_of(fired, [c], hits, events, stored).count() == 0 and joint.alerts_of(fired, [c], hits, events).count() == 1


def test_a_noisy_key_is_many_tasks(spark):
    """Half of all hits have one key: no group of rows that are sorted together holds much of them, and what fires is the same."""
    rows = [(f"n{i}", "A", "b", i * 3, {"u": "noisy"}) for i in range(1500)] + [(f"e{i}", "A", "b", i * 3, {"u": f"u{i % 50}"}) for i in range(1500)]
    c, hits = corr("event_count", ["A"], 30, {"gte": 11}), table(spark, rows)
    made = joint.sliced(joint._streams(hits, joint.Rules([c])))
    most = max(r["count"] for r in made.groupBy("keys", "slice").count().collect())
    assert most <= 100 and made.where("home").count() == 3000 and made.count() <= 3000 * (1 + 2 / joint.SLICE)
    assert shown(joint.evaluate_all(hits, [c]), [c]) == one_by_one(hits, [c]) and joint.evaluate_all(hits, [c]).count() == 1490


def test_levels():
    a = corr("temporal", [("Y", "correlation")], 10, id="a", title="X")
    b = corr("temporal", [("X", "correlation")], 10, id="b", title="Y")
    c = corr("temporal", [("Y", "correlation"), ("A", "rule")], 10, id="c", title="Z")
    d = corr("event_count", ["A"], 10, {"gte": 1}, id="d", title="W", level="informational")
    e = corr("event_count", [("C", "correlation"), ("A", "rule")], 10, {"gte": 1}, id="e", title="V")
    f = corr("event_count", ["A"], 10, {"gte": 1}, id="f", title="C")
    titles = [[x.title for x in level] for level in joint.levels([e, c, a, b, d, f])]
    at = {t: i for i, level in enumerate(titles) for t in level}
    assert at["C"] == 0 and at["V"] == 1 and at["Z"] > at["Y"] and "W" not in at and abs(at["X"] - at["Y"]) == 1
    assert joint.levels([d]) == []


def test_tasks_follow_the_rows_of_rules(spark):
    """Hits times the rules of their title, not what is shuffled, decide how many tasks sort."""
    rows = [(f"a{i}", "A", "b", i, {"u": str(i % 9)}) for i in range(300)] + [(f"b{i}", "B", "b", i, {"u": "1"}) for i in range(50)]
    rules = joint.Rules([corr("event_count", ["A"], 10, {"gte": 2}, id=f"k{i}", title=f"K{i}") for i in range(10)])
    assert joint.tasks(table(spark, rows), rules, 100) == 30
    assert joint.tasks(table(spark, rows), rules) == spark.sparkContext.defaultParallelism
