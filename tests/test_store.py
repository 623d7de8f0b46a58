"""Events, alerts, sources, sinks, the knowledge base and streaming."""

from __future__ import annotations

import hashlib
import json
import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logwarden import queries as Q
from logwarden.functions import jsontext as J
from logwarden.operators import alerts as A
from logwarden.operators import events as E
from logwarden.operators import kb as K
from logwarden.operators import matching as M
from logwarden.operators.registry import Registry
from logwarden.plans.catalog import Correlation
from logwarden.plans.filters import compile_filter
from logwarden.plans.sigma import Rule
from logwarden.sources import readers as R
from logwarden.sources import sinks
from logwarden.sources.sinks import VersionedTable
from logwarden.streaming import ingest
from logwarden.streaming.ingest import Pipeline, stream_health, without_repeats
from logwarden.streaming.intake import Intake, IntakeFull

RULE = Rule("r", "Bad", "high", tags=("attack.t1059.001", "attack.execution", "x"), detection={"s": {"Image|endswith": "\\bad.exe"}, "condition": "s"})


def events(spark, rows, batch="b"):
    df = R.from_dicts(spark, rows, batch)
    return E.canonical(df, key=F.sha2("raw", 256))


def test_canonical_and_alerts(spark):
    rows = [{"Hostname": h, "Image": "C:\\bad.exe", "EventTime": f"2024-01-01 00:00:{i:02}", "TargetUserName": u} for i, (h, u) in enumerate([("h1", "zed"), ("h1", "amy"), ("h2", "bob")])] + [{"Image": "C:\\ok.exe", "SystemTime": "2024-01-01T00:00:00.5Z"}]
    m = M.match(events(spark, rows), [RULE])
    got = {r.host: r for r in A.group_matches(M.matches(m)).collect()}
    assert set(got) == {"h1", "h2"} and got["h1"].event_count == 2 and got["h1"].entities.users == ["amy", "zed"] and got["h1"].mitre_techniques == ["attack.t1059.001"]
    assert got["h1"].dedup_key == hashlib.sha256(b"r:h1:amy").hexdigest()[:16] and [json.loads(x)["TargetUserName"] for x in got["h1"].sample_events] == ["zed", "amy"]
    plain = m.where(~F.col("is_matched")).first()
    assert plain.host == "unknown-host" and plain.event_ts == datetime(2024, 1, 1, 0, 0, 0, 500000) and m.count() == 4
    scoped = A.group_matches(M.matches(m), scope_by_source=True).select("dedup_key").collect()
    assert {r[0] for r in scoped}.isdisjoint({r.dedup_key for r in got.values()})
    assert A.group_matches(M.matches(m).withColumn("rule_level", F.lit("odd"))).count() == 0


def test_samples_head_and_tail(spark):
    rows = [{"Hostname": "h", "Image": "bad.exe\\bad.exe", "EventTime": f"2024-01-01 00:00:{i:02}", "n": i} for i in range(20)]
    a = A.group_matches(M.matches(M.match(events(spark, rows), [RULE]))).first()
    assert [json.loads(x)["n"] for x in a.sample_events] == [0, 1, 2, 3, 4, 15, 16, 17, 18, 19] and a.event_count == 20


def test_upserts_and_status(spark):
    base = "dedup_key string, source_batch string, host string, rule_title string, event_count long, sample_events array<string>, status string, alert_id string"
    row = lambda n, s="new", k="k", b="b": (k, b, "h", "t", n, [str(n)], s, f"id-{k}")
    none = spark.createDataFrame([], base)
    one = A.upsert(none, spark.createDataFrame([row(1)], base))
    two = A.upsert(A.set_status(one, "id-k", "closed"), spark.createDataFrame([row(3), row(2, k="j"), row(4, k="j", b="c")], base))
    got = {r.dedup_key: r for r in two.collect()}
    assert got["k"].event_count == 4 and got["k"].status == "closed" and got["k"].sample_events == ["3"] and got["j"].event_count == 6 and got["j"].source_batch == "b"
    over = A.upsert(spark.createDataFrame([row(10)], base), spark.createDataFrame([row(3)], base), add=False)
    assert over.first().event_count == 3 and A.get_alert(over, "id-k").count() == 1 and A.get_alert(over, "no").count() == 0


def test_lists_facets_and_limits(spark):
    rows = [{"EventID": 1, "a": 1}, {"EventID": 1, "a": "1"}, {"EventID": 2, "a": 1.0}, {"EventID": 3}]
    e = events(spark, rows)
    assert {(r.value, r.n) for r in E.facet(e, "EventID").collect()} == {("1", 2), ("2", 1), ("3", 1)}
    assert sorted((str(r.value), r.is_number, r.n) for r in E.facet(e, "a").collect()) == [("1", False, 1), ("1", True, 2), ("None", False, 1)]
    assert E.facet_total(e, "a").first()[0] == 3 and [(r.value, r.n) for r in E.facet(e, "EventID", query="a = 1").collect()] == [("1", 2)]
    for bad in (0, 501):
        with pytest.raises(ValueError):
            E.list_events(e, limit=bad)
    page = E.list_events(e, "EventID", False, ["a", " "], 2, 1).collect()
    assert len(page) == 2 and "raw" not in page[0] and E.batch_label(e) == "b"


def test_readers(spark, tmp_path):
    (tmp_path / "e.ndjson").write_text('{"a": 1}\n\n{"a": "x"}\n')
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 2}]\n')
    (tmp_path / "lines.json").write_text('[\n{"a": 1},\n{"a": 2}\n]\n')
    (tmp_path / "t.csv").write_text('a,b\n1,"x, ""y"""\n,z\n')
    (tmp_path / "au.log").write_text('type=SYSCALL msg=audit(1704067200.123:42): pid=7 comm="cat x" pid=8\n')
    (tmp_path / "w.xml").write_text('<Events><Event><System><EventID>4624</EventID><Computer>h</Computer><TimeCreated SystemTime="2024-01-01T00:00:00Z"/></System><EventData><Data Name="TargetUserName">bob</Data><Data Name="X">1</Data></EventData></Event></Events>')
    read = lambda name, **k: [json.loads(r.raw) for r in R.read_events(spark, str(tmp_path / name), **k).collect()]
    assert read("lines.json") == [{"a": 1}, {"a": 2}]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "1.json").write_text(json.dumps([{"a": i, "b": {"c": [1]}} for i in range(3)], indent=2))
    (tmp_path / "many" / "2.json").write_text('{"a": 9}\n[{"a": 8}]\n')
    assert sorted(x["a"] for x in read("many")) == [0, 1, 2, 8, 9]
    assert read("e.ndjson") == [{"a": 1}, {"a": "x"}] and read("arr.json") == [{"a": 1}, {"a": 2}]
    assert [json.loads(r.raw) for r in R.read_json_array(spark, str(tmp_path / "lines.json")).collect()] == [{"a": 1}, {"a": 2}]
    assert read("t.csv") == [{"a": "1", "b": 'x, "y"'}, {"b": "z"}]
    assert read("au.log") == [{"type": "SYSCALL", "msg": "audit(1704067200.123:42):", "pid": "7", "comm": "cat x", "SystemTime": "2024-01-01T00:00:00"}]
    got = read("w.xml")[0]
    assert got["TargetUserName"] == "bob" and got["EventID"] == "4624" and got["Computer"] == "h" and got["SystemTime"].startswith("2024-01-01")
    assert R.read_events(spark, str(tmp_path / "e.ndjson")).first().source_batch == "e"
    assert [R.input_type(x) for x in ("a.EVTX", "a.log", "a.xml", "a.bin", "a.csv")] == ["evtx", "auditd", "xml", "json", "csv"]
    assert R.parse_body('[{"a": 1}]') == R.parse_body('{"a": 1}\n\n') == [{"a": 1}]
    with pytest.raises(ValueError):
        R.parse_body("[1]")
    with pytest.raises(ValueError):
        R.from_dicts(spark, [], "x")
    with pytest.raises(ValueError):
        R.read_events(spark, "x", "strange")


def test_no_line_of_json_is_lost(spark, tmp_path):
    """Bad lines, wherever they are, are events; other lines and files are as they were."""
    def read(text, **k):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.json"
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return sorted(r.raw for r in R.read_json(spark, str(path), **k).collect())

    good = ['{"a":1}', '{"a":2}', '{"a":3}']
    assert read("\n".join([*good[:2], "[2024-01-01] plain line", good[2]])) == sorted([*good, "[2024-01-01] plain line"])
    assert read("\n".join([good[0], '[{"a":2}', good[2]])) == sorted([good[0], '[{"a":2}', good[2]])
    assert read("\n".join(["[2024] first line", *good])) == sorted(["[2024] first line", *good])
    assert read("[" + ",\n".join(good) + "]") == good and read('\n \n[\n{"a":\n1}]') == good[:1] and read(b"\xef\xbb\xbf[\n" + ",\n".join(good).encode() + b"]") == good
    assert read('[{"a":1}, {"a":2}]\n[{"a":3}]\n') == good and read('{"a":1}\n[{"a":2},{"a":3}]\n{broken\n') == sorted([*good, "{broken"])
    assert read("") == [] == read(" \n\n") and read("[\n{}", layout="lines") == ["[", "{}"] and read("[{}]", layout="array") == ["{}"]
    import gzip
    (tmp_path / "z.json.gz").write_bytes(gzip.compress(("[" + ",\n".join(good) + "]").encode()))
    assert sorted(r.raw for r in R.read_json(spark, str(tmp_path / "z.json.gz")).collect()) == good
    (tmp_path / "odd name #1").mkdir()
    (tmp_path / "odd name #1" / "a b%.json").write_text("[\n" + good[0] + "]")
    (tmp_path / "odd name #1" / "c.json").write_text(good[1])
    assert sorted(r.raw for r in R.read_json(spark, str(tmp_path / "odd name #1")).collect()) == good[:2]
    with pytest.raises(ValueError):
        R.read_json(spark, "x", "odd")
    bad = spark.createDataFrame([("{}",), ("[1]",), ("x",), (None,), ("1",), ('{"a": [1]}',)], "raw string").select(R.malformed(F.col("raw")).alias("m"))
    assert [r.m for r in bad.collect()] == [False, True, True, True, True, False]


def test_intake_loses_nothing(spark, tmp_path, monkeypatch):
    """A write that fails gives back its own source's events and those not yet written; what is written isn't written again."""
    intake = Intake(spark, str(tmp_path / "in"), events=1)
    for s in "xyz":
        intake.offer([{"s": s, "i": i} for i in range(2)], s)
    write = intake._write
    monkeypatch.setattr(intake, "_write", lambda s, rows: write(s, rows) if s == "x" else (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        intake.flush()
    intake.offer([{"s": "y", "i": 2}], "y")
    monkeypatch.setattr(intake, "_write", write)
    assert intake.flush() == 5 and intake.flush(True) == 0
    lines = sorted(x for f in (tmp_path / "in").glob("*.ndjson") if not f.name.startswith("_") for x in f.read_text().split("\n"))
    assert lines == sorted(json.dumps({"s": s, "i": i}) for s in "xyz" for i in range(3 if s == "y" else 2))


def test_registry(spark):
    r = Registry()
    s, token = r.create("Web 1.a-b", "d")
    for bad in ("", "x" * 65, "a/b", "Web 1.a-b"):
        with pytest.raises(ValueError):
            r.create(bad)
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert r.authenticate(token, now).last_seen_at == now.isoformat() and r.authenticate(token, now + timedelta(seconds=5)).last_seen_at == now.isoformat()
    assert r.authenticate(token, now + timedelta(seconds=61)).last_seen_at != now.isoformat() and r.authenticate("no") is None
    new = r.rotate(s.source_id)
    assert r.authenticate(token) is None and r.authenticate(new) and r.update(s.source_id, enabled=False).enabled is False and r.authenticate(new) is None
    assert "token_sha256" not in r.table(spark).columns and r.table(spark).count() == 1 and r.delete(s.source_id) and r.rotate(s.source_id) is None


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "a int")
    assert t.read().count() == 0
    for i in range(3):
        t.replace(t.read().unionByName(spark.createDataFrame([(i,)], "a int")))
    assert sorted(r.a for r in t.read().collect()) == [0, 1, 2] and len(list((tmp_path / "t").glob("v-*"))) == 2


def test_knowledge_base(spark, tmp_path):
    kb = K.build(Q.bundle(spark), {"source": "test"})
    K.write(kb, str(tmp_path / "kb"))
    kb = K.load(spark, str(tmp_path / "kb"))
    said = K.meta(kb)
    assert said["available"] and said["technique_count"] == "3" and said["source"] == "test" and said["attack_version"] == "1.0"
    assert K.meta(K.load(spark, str(tmp_path / "none"))) == {"available": False}
    one = kb["mitre_technique"].where("technique_id = 'T1059'").first()
    assert one.detection == "Watch it" and one.data_sources == ["Process: Creation"] and not one.is_subtechnique
    assert kb["mitre_tactic"].where("name = 'Nameless'").count() == 0
    card = K.technique_card(kb, "T1059").first()
    assert [s.sub_id for s in card.subtechniques] == ["T1059.001"] and card.strategies[0].analytics[0].analytic_id == "AN0001"
    assert K.search(kb, q="t1059%").count() == 2 and K.search(kb, tactic="TA0001").count() == 1
    with pytest.raises(ValueError):
        K.check(kb)
    path = tmp_path / "b.json"
    objects = [{k: v for k, v in json.loads(r[0]).items() if v is not None} for r in Q.bundle(spark).select(F.to_json(F.struct("*"))).collect()]
    path.write_text(json.dumps({"type": "bundle", "objects": objects}, indent=1))
    assert {n: t.count() for n, t in K.build(K.read_bundle(spark, str(path))).items() if n != "mitre_meta"} == {n: t.count() for n, t in kb.items() if n != "mitre_meta"}


def test_alert_detail_and_promoted_fields(spark, tmp_path):
    kb = K.build(Q.bundle(spark))
    a = spark.createDataFrame([("1", ["T1078", "T9999"]), ("2", [])], "alert_id string, mitre_techniques array<string>")
    t = A.alert_detail(a, "1", kb).first().techniques
    assert [(x.technique_id, x.matched, x.tactics) for x in t] == [("T1078", True, ["TA0002", "TA0001"]), ("T9999", False, [])]
    assert A.alert_detail(a, "2", kb).first().techniques is None and A.alert_detail(a, "1", None).first().techniques is None
    events(spark, [{"EventID": 1}, {"EventID": 2}]).write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e")).where(compile_filter("EventID = 2", promoted={"EventID": F.col("event_code")}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1 and "EqualTo(event_code,2)" in plan and J.sanitised("src_ip@x") == "srcipx"


FAIL = Rule("f", "Fail", "informational", detection={"s": {"EventID": 4625}, "condition": "s"})
BURST = Correlation("c", "Burst", "event_count", ("IpAddress",), 300, {"gte": 10}, (("Fail", "rule"),), "high")


def failed(gap, n=10, bad=0):
    return [{"EventID": 4625, "EventTime": f"2024-01-01 {(i * gap) // 3600:02}:{(i * gap) // 60 % 60:02}:{(i * gap) % 60:02}", "Hostname": "h", "IpAddress": f"10.0.0.{gap}", "TargetUserName": "u"} for i in range(n)] + [{"Image": "\\bad.exe", "Hostname": "w"}] * bad


def test_stream_equals_batch_and_retries_add_nothing(spark, tmp_path):
    rows = failed(20, bad=2) + failed(40)
    folder = tmp_path / "in"
    folder.mkdir()
    p = Pipeline(spark, str(tmp_path / "live"), lambda: [RULE, FAIL], lambda: [BURST])
    for k, part in enumerate((rows[:7], rows[7:15], rows[15:])):
        (folder / f"src{k}.tmp").write_text("\n".join(json.dumps(r) for r in part))
        (folder / f"src{k}.tmp").rename(folder / f"src{k}.json")
        time.sleep(0.1)
    stream = R.stream_events(spark, str(folder), max_files=1).withColumn("source_batch", F.lit("s"))
    q = p.start(stream, str(tmp_path / "cp"), None)
    q.awaitTermination()
    assert q.exception() is None and not stream_health(q)["active"]
    whole = Pipeline(spark, str(tmp_path / "whole"), lambda: [RULE, FAIL], lambda: [BURST])
    whole.process(R.from_dicts(spark, rows, "s"), 0)
    shown = lambda x: sorted((r.rule_title, r.host, r.event_count, r.dedup_key) for r in x.alerts.read().collect())
    assert shown(p) == shown(whole) and {r[0]: r[2] for r in shown(p)} == {"Bad": 2, "Burst": 10}
    assert p.events().count() == len(rows) == whole.events().count()
    before = shown(whole), whole.events().count(), whole.hits().count()
    whole.process(R.from_dicts(spark, rows, "s"), 0)
    assert (shown(whole), whole.events().count(), whole.hits().count()) == before
    n_hits = whole.hits().count()
    assert whole.delete_batch("other") == (0, 0) and p.delete_batch("s") == (len(rows), 2) and p.alerts.read().count() == 0 and p.events().count() == 0
    events_gone, hits_gone = whole.expire("9999")
    left = whole.hits().collect()
    assert events_gone == len(rows) and whole.events().count() == 0 and hits_gone == n_hits - len(left) and all(r.event_id.startswith("corr:") for r in left)


def test_an_empty_store_and_one_job_for_many_folders(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path / "none"), lambda: [RULE])
    assert p.expire("9999") == (0, 0) and p.events().count() == 0 == p.hits().count() and p.delete_batch("x") == (0, 0)
    path = str(tmp_path / "t")
    for b in range(6):
        sinks.append_once(spark.range(20).select(F.concat(F.lit(f"e{b}-"), F.col("id")).alias("event_id"), F.col("id").alias("v"), F.lit(b // 2).alias("w")), path, b)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert sinks.remove_where(spark, path, F.col("v") < F.when(F.col("w") == 0, 20).when(F.col("w") == 1, 5).otherwise(0)) == 2 * 20 + 2 * 5
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 6
    left = {r[0]: r[1] for r in spark.read.parquet(path).groupBy("micro_batch").count().collect()}
    assert left == {2: 15, 3: 15, 4: 20, 5: 20}


def test_what_a_crash_moved_aside_comes_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for b in range(2):
        sinks.append_once(spark.range(10).withColumn("event_id", F.col("id").cast("string")), path, b)
    real = sinks.exists
    top = tmp_path / "t"
    (top / "micro_batch=0").rename(top / f"_old-{'a' * 32}-micro_batch~0")
    (top / f"_old-{'b' * 32}-micro_batch~1").mkdir()
    (top / f"_new-{'c' * 32}").mkdir()
    assert spark.read.parquet(path).count() == 10 and sinks.recover(spark, path) == 1 and spark.read.parquet(path).count() == 20
    assert sorted(x.name for x in top.iterdir()) == ["micro_batch=0", "micro_batch=1"] and real(spark, path)


def test_a_look_up_reads_few_row_groups(spark, tmp_path):
    """Ids are hashes, so only the filters tell which of 50 files holds one."""
    path = str(tmp_path / "t")
    sinks.append_once(spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.lit("x").alias("raw")).repartition(50, "event_id"), path, 0)
    stored = spark.read.parquet(path)
    one = E.get_event(stored, hashlib.sha256(b"777").hexdigest())
    found = stored.where(F.col("event_id") == hashlib.sha256(b"777").hexdigest())
    assert len(one.collect()) == 1 == len(found.collect())
    rows = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert rows <= 3 * 1100


class Crash(Exception):
    pass


def test_a_run_that_ends_anywhere_is_made_good(spark, tmp_path, monkeypatch):
    """The first run of a batch ends after each of its writes, and within the last one; the second run finds and leaves what one run would."""
    rows = failed(20, bad=3)
    clean = Pipeline(spark, str(tmp_path / "clean"), lambda: [RULE, FAIL], lambda: [BURST])
    for i, part in enumerate((rows[:6], rows[6:])):
        clean.process(R.from_dicts(spark, part, "s"), i)
    shown = lambda x: (sorted((r.rule_title, r.host, r.event_count, r.dedup_key) for r in x.alerts.read().collect()), x.events().count(), sorted((r.rule_title, str(r.event_ts)) for r in x.hits().collect()))
    want = shown(clean)
    write, replace = ingest.append_once, VersionedTable.replace
    for k in range(5):
        p = Pipeline(spark, str(tmp_path / f"crash{k}"), lambda: [RULE, FAIL], lambda: [BURST])
        p.process(R.from_dicts(spark, rows[:6], "s"), 0)
        before = p.alerts.read().count()
        done = []

        def counted(*a, f=write, k=k, done=done):
            f(*a)
            done.append(1)
            if len(done) == k + 1:
                raise Crash

        with monkeypatch.context() as m:
            m.setattr(ingest, "append_once", counted)
            if k == 3:
                m.setattr(VersionedTable, "replace", lambda self, *a: (replace(self, *a), (_ for _ in ()).throw(Crash()))[0])
            if k == 4:
                m.setattr(sinks.json, "dumps", lambda *a, **b: (_ for _ in ()).throw(Crash()))
            with pytest.raises(Crash):
                p.process(R.from_dicts(spark, rows[6:], "s"), 1)
        if k != 3:
            assert p.alerts.read().count() == before and p.alerts.note() == {"last_batch": 0}
        p.process(R.from_dicts(spark, rows[6:], "s"), 1)
        assert shown(p) == want, k


def test_alert_identity(spark):
    """The third part of a key is the first user, or the host if there is none."""
    rows = [{"Hostname": "h1", "Image": "\\bad.exe"}, {"Image": "\\bad.exe"}, {"Hostname": "h2", "Image": "\\bad.exe", "User": "zoe"}, {"Hostname": "h2", "Image": "\\bad.exe", "SubjectUserName": "abe"}]
    got = {r.host: (r.dedup_key, r.event_count) for r in A.group_matches(M.matches(M.match(events(spark, rows), [RULE]))).collect()}
    key = lambda *p: hashlib.sha256(":".join(p).encode()).hexdigest()[:16]
    assert got == {"h1": (key("r", "h1", "h1"), 1), "unknown-host": (key("r", "unknown-host", "unknown-host"), 1), "h2": (key("r", "h2", "abe"), 2)}


def test_first_present_fields(spark):
    """Order of preference, and what counts as present: JSON kinds of every sort."""
    cases = [
        ({"SourceIp": "2", "IpAddress": "1"}, "src_ip", "1"), ({"IpAddress": "", "SourceIp": "2"}, "src_ip", "2"), ({"ComputerName": "c", "host": "h"}, "host", "h"), ({"Hostname": 0, "Computer": "x"}, "host", "x"),
        ({"Hostname": "0"}, "host", "0"), ({"Hostname": False, "host": True}, "host", "True"), ({"Hostname": "false"}, "host", "false"), ({"Hostname": [], "Computer": {}, "host": [1]}, "host", "[1]"),
        ({"Hostname": 1.5}, "host", "1.5"), ({"Hostname": 0.0, "Computer": -0.0, "host": 7}, "host", "7"), ({}, "host", "unknown-host"), ({"EventCode": 5}, "event_code", "5"), ({"CommandLine": "x -a", "exe": "y"}, "process", "x -a"),
        ({"Hostname": {"a": "b c"}}, "host", '{"a":"b c"}'), ({"@timestamp": "2024-01-01T00:00:01Z", "timestamp": "2025"}, "event_time", "2024-01-01T00:00:01Z"),
    ]
    df = spark.createDataFrame([(i, json.dumps(e)) for i, (e, _, _) in enumerate(cases)], "i int, raw string")
    got = {r.i: r for r in E.promote(df).collect()}
    assert [got[i][c] for i, (_, c, _) in enumerate(cases)] == [w for _, _, w in cases]
    # Looked up in one parse, or read one by one.
    names = ["Hostname", "Computer", "host"]
    parsed, at = J.with_texts(df, names)
    both = parsed.select(*[J.text(F.col("raw"), n, at[n]).eqNullSafe(J.text(F.col("raw"), n)) & J.present(F.col("raw"), n, at[n]).eqNullSafe(J.present(F.col("raw"), n)) for n in names]).collect()
    assert all(all(r) for r in both)


def test_time_bounds_reach_the_scan(spark, tmp_path):
    rows = [{"EventTime": t} for t in ("2024-01-01 00:00:00", "2024-01-05T10:00:00Z", "2024-01-05T12:00:00+03:00", "2024-01-09T00:00:00", "odd 2024", "2024-01-05")] + [{}]
    events(spark, rows).write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    for low, high in (("2024-01-05", "2024-01-05T23:59:59"), (None, "2024-01-05"), ("2024-01-05 10:00:00", None), ("2024-01", "odd"), ("x", None)):
        plain, pushed = (stored.where(E.event_filter(time_from=low, time_to=high, stored=s)) for s in (False, True))
        assert sorted(r.event_id for r in plain.collect()) == sorted(r.event_id for r in pushed.collect())
    assert "event_ts" in stored.where(E.event_filter(time_from="2024-01-05", stored=True))._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:300]


def test_filters_reach_promoted_columns(spark, tmp_path):
    """The same rows with and without the promoted columns, for values of every kind; and equalities are in the scan."""
    r = random.Random(4)
    values = ["x", "1", 1, True, "true", "0", 0, False, "", None, "X", 4625, "4625", 4625.0, [], {"a": 1}]
    rows = [{k: v for k in ("Hostname", "Computer", "EventID", "EventCode", "TargetUserName", "IpAddress") if (v := r.choice(values)) is not None or r.random() < 0.5} for _ in range(150)]
    events(spark, rows).write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    for text in ("Hostname = x", "hostname = x", "eventid = 4625 and Hostname != x", "EventID in (4625, x)", "EventID in (4625, 0)", "Hostname = 1", "Hostname = true", "Hostname = '' or EventID = 4625", "not (Hostname = x)", "Hostname = 0.0", "TargetUserName = X and (IpAddress = x or IpAddress = 4625) and EventID = 4625.0", "Computer = x"):
        plain, pushed = (sorted(x.event_id for x in stored.where(E.event_filter(query=text, stored=s)).collect()) for s in (False, True))
        assert plain == pushed, text
    plan = stored.where(E.event_filter(query="EventID = 4625 and Hostname = x", stored=True))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_code,4625)" in plan and "EqualTo(host,x)" in plan


def test_intake(spark, tmp_path):
    clock = [0.0]
    intake = Intake(spark, str(tmp_path / "in"), events=3, seconds=5.0, capacity=4, clock=lambda: clock[0])
    assert intake.offer([{"a": 1}], "x") == 1 and intake.flush() == 0
    clock[0] = 6.0
    assert intake.due() and intake.flush() == 1
    with pytest.raises(IntakeFull) as e:
        intake.offer([{"a": i} for i in range(9)], "y")
    assert (e.value.accepted, e.value.offered) == (4, 9) and intake.flush() == 4 and intake.offer([{"b": "é"}], "y.z") == 1 and intake.flush(force=True) == 1
    got = []
    q = R.stream_events(spark, str(tmp_path / "in")).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: got.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.source_batch, r.raw) for r in got) == sorted([("x", '{"a": 1}'), *[("y", f'{{"a": {i}}}') for i in range(4)], ("y.z", '{"b": "é"}')])


def test_repeats_in_a_stream(spark, tmp_path):
    """Contents that came within the delay are dropped; the same content of another source is kept."""
    (tmp_path / "in").mkdir()
    for k, lines in enumerate((["a", "b", "a"], ["a", "c"])):
        (tmp_path / "in" / f"f{k}.json").write_text("\n".join(lines))
    stream = R.stream_events(spark, str(tmp_path / "in"), 1).withColumn("source_batch", F.when(F.col("raw") == "c", "other").otherwise("s")).withColumn("event_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    stream = stream.unionByName(stream.withColumn("source_batch", F.lit("s2")).where("raw = 'b'"))
    q = without_repeats(stream).writeStream.format("memory").queryName("kept_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.source_batch, r.raw) for r in spark.table("kept_rows").collect()) == [("other", "c"), ("s", "a"), ("s", "b"), ("s2", "b")]
