"""Pages by cursor are the pages by offset."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from logwarden.functions import jsontext as J
from logwarden.operators import alerts as A
from logwarden.operators import events as E
from logwarden.operators.paging import last_cursor, seek


@pytest.mark.parametrize("down", [(False, False), (True, False), (False, True), (True, True)])
def test_all_pages_are_the_whole_order(spark, tmp_path, down):
    """Ties, nulls, infinities and not-a-number in two keys; the id tells rows apart."""
    r = random.Random(1)
    rows = [(r.choice([None, 1.5, -2.0, float("nan"), float("inf")]), r.choice([None, "", "a", 'b"', "ü"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y string, id int").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    keys = [(F.col("x"), down[0]), (F.col("y"), down[1]), (F.col("id"), False)]
    want = [x.id for x in stored.orderBy(*[k.desc() if d else k.asc() for k, d in keys]).collect()]
    got, after = [], None
    while len(got) < 80:
        page = seek(stored, keys, after, 17)
        found = page.collect()
        got += [x.id for x in found]
        if not found:
            break
        after = found[-1].cursor
    assert got == want
    with pytest.raises(ValueError):
        seek(stored, keys, '{"z": 1}')


def test_a_late_page_reads_no_more_than_the_first(spark, tmp_path):
    """40 files, each of a range of times: the last page reads the last of them only, and nothing is sorted as a whole."""
    spark.range(40_000).repartitionByRange(40, "id").select(F.format_string("2024-%08d", "id").alias("ingested_at"), F.col("id").cast("string").alias("event_id")).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    keys = [(F.col("ingested_at"), True), (F.col("event_id"), False)]
    cut = json.dumps({"key_0_": "2024-00000100", "key_1_": "100"})
    page = seek(stored, keys, cut, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and "LessThan(ingested_at,2024" in plan
    assert [x.event_id for x in page.collect()] == [str(i) for i in range(99, 89, -1)]
    assert page._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value() <= 2000


def test_events_and_alerts(spark):
    e = E.canonical(spark.createDataFrame([(json.dumps({"n": v, "Hostname": f"h{i % 2}"} if v is not None else {}), "s") for i, v in enumerate([3, 20, "x", None, 3, "y", 1.0])], "raw string, source_batch string"), key=F.xxhash64("raw", F.monotonically_increasing_id()))
    e = spark.createDataFrame(e.collect(), e.schema)
    for by, down in (("n", True), ("n", False), ("host", False), (None, True)):
        want = [x.event_id for x in E.list_events(e, by, down, limit=500).collect()]
        first = E.seek_events(e, None, by, down, limit=3)
        second = E.seek_events(e, last_cursor(first), by, down, ["n"], limit=4)
        assert [x.event_id for x in first.collect()] + [x.event_id for x in second.collect()] == want, by
    with pytest.raises(ValueError):
        E.seek_events(e, limit=501)
    assert last_cursor(E.seek_events(e, None, query="n = 99")) is None
    a = spark.createDataFrame([(f"k{i}", f"h{i % 2}", i % 3, "new", f"t{i % 2}", lv, "b", ["s"]) for i, lv in enumerate(("high", "low", "odd", "critical", "high"))], "dedup_key string, host string, event_count long, status string, created_at string, rule_level string, source_batch string, sample_events array<string>")
    for by, down in (("rule", True), ("rule", False), ("event_count", True), ("host", False), ("nothing", False)):
        want = [x.dedup_key for x in A.list_alerts(a, sort_by=by, descending=down).collect()]
        first = A.seek_alerts(a, None, by, down, 2, source_batch="b")
        assert [x.dedup_key for x in first.collect()] + [x.dedup_key for x in A.seek_alerts(a, last_cursor(first), by, down).collect()] == want and "sample_events" not in first.columns, by


def test_a_page_by_a_field_reads_each_event_once(spark, capsys):
    """The sort keys are columns, not expressions over the events that each comparison makes anew, and a page is each task's least rows."""
    rows = [(str(i), f'{{"f": {json.dumps([None, i % 7, str(i % 5), True][i % 4])}}}') for i in range(40)]
    e = spark.createDataFrame(rows, "event_id string, raw string").withColumns({"is_matched": F.lit(False), "event_time": F.lit(""), "matched_rules": F.array(F.lit(""))})
    for page in (E.list_events(e, "f", False, ["f"], 10), E.seek_events(e, E.seek_events(e, None, "f", True, limit=3).collect()[-1].cursor, "f", True, ["f"], 10)):
        page.explain()
        plan = capsys.readouterr().out
        assert "TakeOrdered" in plan and "get_json_object" not in plan.split("orderBy=")[1].split("output=")[0] and "rangepartitioning" not in plan
    shown = [(r.event_id, r.extra.get("f")) for r in E.list_events(e, "f", False, ["f"], 40).collect()]
    want = e.orderBy(*J.order_rank(F.col("raw"), "f"), "event_id").select("event_id", J.text(F.col("raw"), "f")).collect()
    assert shown == [tuple(r) for r in want]
