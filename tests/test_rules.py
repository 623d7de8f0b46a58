"""Sigma compilation, packs, catalogue and value lists."""

from __future__ import annotations

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators import matching as M
from logwarden.plans.catalog import CATALOG, Catalog, check_correlation, load_correlations, resolve_correlations, search_rules
from logwarden.plans.sigma import Rule, RuleError, base64_offsets, compile_rule, documents, windash
from logwarden.plans.value_lists import ListError, ValueLists, is_list_document, parse_lists
from logwarden.sources.sinks import VersionedTable

EVENTS = [
    {"id": 0, "Image": "C:\\Windows\\evil.exe", "CommandLine": "evil.exe -enc abc", "n": 5, "ip": "192.168.1.7", "EventID": 1},
    {"id": 1, "Image": "C:\\Tools\\GOOD.EXE", "CommandLine": "good /enc abc", "n": "12", "ip": "10.1.2.3", "EventID": 4688},
    {"id": 2, "Image": None, "CommandLine": "", "n": 7.5, "ip": "fe80::1", "a": "x", "b": "X"},
    {"id": 3, "CommandLine": "star* and ?mark 100% a_b", "ip": "999.1.1.1", "flag": True},
    {"id": 4, "Image": "/usr/bin/evil", "CommandLine": base64.b64encode(b"..powershell..").decode(), "note": "p\x00o\x00w\x00"},
]


def match(spark, detection, lists=None, **more):
    df = spark.createDataFrame([(e["id"], json.dumps(e)) for e in EVENTS], "id long, raw string")
    r = compile_rule({"title": "t", "detection": detection})[0]
    return sorted(x.id for x in df.where(r.predicate(F.col("raw"), lists, **more)).collect())


@pytest.mark.parametrize("detection, want", [
    ({"s": {"Image|endswith": "\\EVIL.exe"}, "condition": "s"}, [0]),
    ({"s": {"Image|endswith": ["evil.exe", "evil"]}, "condition": "s"}, [0, 4]),
    ({"s": {"Image|endswith|cased": "EVIL.exe"}, "condition": "s"}, []),
    ({"s": {"n": 12}, "condition": "s"}, [1]), ({"s": {"n": ["5", 7.5]}, "condition": "s"}, [0, 2]),
    ({"s": {"n|gte": 7}, "condition": "s"}, [1, 2]),
    ({"s": {"Image": None}, "condition": "s"}, [2, 3]), ({"s": {"CommandLine": ""}, "condition": "s"}, [2]),
    ({"s": {"Image|exists": True}, "condition": "s"}, [0, 1, 4]), ({"s": {"Image|exists": False}, "condition": "s"}, [2, 3]),
    ({"s": {"CommandLine|re": "^evil.*abc$"}, "condition": "s"}, [0]), ({"s": {"CommandLine|re|i": "^EVIL"}, "condition": "s"}, [0]),
    ({"s": {"CommandLine|contains": "\\*"}, "condition": "s"}, [3]), ({"s": {"CommandLine|contains": "100%"}, "condition": "s"}, [3]), ({"s": {"CommandLine": "star\\* and \\?mark*"}, "condition": "s"}, [3]),
    ({"s": {"CommandLine|contains": "a?b"}, "condition": "s"}, [3]),
    ({"s": {"CommandLine|contains|all": ["evil", "abc"]}, "condition": "s"}, [0]),
    ({"s": {"CommandLine|windash|contains": " -enc"}, "condition": "s"}, [0, 1]),
    ({"s": {"ip|cidr": "192.168.0.0/16"}, "condition": "s"}, [0]), ({"s": {"ip|cidr": ["10.0.0.0/8", "fe80::/10"]}, "condition": "s"}, [1, 2]),
    ({"s": {"CommandLine|base64offset|contains": "powershell"}, "condition": "s"}, [4]),
    ({"s": {"note|wide|contains": "pow"}, "condition": "s"}, [4]), ({"s": {"flag": True}, "condition": "s"}, [3]),
    ({"s": {"a|fieldref": "b"}, "condition": "s"}, [2]), ({"s": {"a|fieldref|cased": "b"}, "condition": "s"}, []),
    ({"k": ["evil", "GOOD"], "condition": "k"}, [0, 1, 4]),
    ({"s": [{"n": 5}, {"ip": "fe80::1", "a": "x"}], "condition": "s"}, [0, 2]),
    ({"a": {"n": 5}, "b": {"n|gt": 6}, "condition": "not a and b or a"}, [0, 1, 2]),
    ({"s": {"EventID|exists": True}, "f": {"n": 5}, "condition": "s and not (f)"}, [1]),
    ({"s_1": {"n": 5}, "s_2": {"n|gt": 4}, "x": {"n": 12}, "condition": "all of s_* or 1 of x"}, [0, 1]),
    ({"a": {"n": 5}, "b": {"Image|contains": "evil"}, "c": {"EventID": 1}, "condition": "2 of them"}, [0]),
    ({"a": {"n": 5}, "b": {"n": 12}, "condition": ["a", "b"]}, [0, 1]),
    ({"s": {"n": 5}, "f": {"Image": "zzz"}, "condition": "not f"}, [0, 1, 4]),
])
def test_detections(spark, detection, want):
    assert match(spark, detection) == want


def test_null_switch_and_lists(spark):
    assert match(spark, {"f": {"Image": "zzz"}, "condition": "not f"}, nulls_match=True) == [0, 1, 2, 3, 4]
    d = {"s": {"Image|endswith|expand": ["%tools%", "\\none.exe"]}, "condition": "s"}
    assert match(spark, d, {"tools": ["evil.exe", "good.exe"]}.get) == [0, 1]
    with pytest.raises(RuleError):
        match(spark, d, {}.get)


@pytest.mark.parametrize("doc", [
    {"title": "t"}, {"detection": {"condition": "a"}}, {"title": "t", "detection": {"s": {"a": 1}}},
    {"title": "t", "detection": {"s": {"a|wrong": 1}, "condition": "s"}}, {"title": "t", "detection": {"s": {"a": 1}, "condition": "s and"}},
    {"title": "t", "detection": {"s": {"a": 1}, "condition": "(s"}}, {"title": "t", "detection": {"s": {"a": 1}, "condition": "x"}}, {"title": "t", "detection": {"s": {"a": 1}, "condition": "1 of y*"}},
])
def test_bad_rules(spark, doc):
    with pytest.raises(RuleError):
        compile_rule(doc)[0].predicate(F.col("raw"))


def test_literal_rewrites():
    assert "bG93" not in base64_offsets(b"\x00")
    for shift in range(3):
        text = base64.b64encode(b"x" * shift + b"hello world" + b"yy").decode()
        assert any(v in text for v in base64_offsets(b"hello world"))
    assert set(windash(" -a")) == {" -a", " /a", " –a", " —a", " ―a"} and windash("a-b") == ["a-b"]


def test_dashes_of_many_options(spark):
    """Any mix of dashes of any number of options; other dashes, and letters' case, as they should be."""
    r = random.Random(0)
    values = ["cmd -a -b -c -d", "/x -y", "a-b", "-one", "Say -é.* \\d"]
    rows = []
    for v in values:
        parts = v.split(" ")
        for _ in range(40):
            mixed = " ".join(r.choice("-/–—―+") + p[1:] if p[:1] in "-/" else p for p in parts)
            rows.append(r.choice(["", "x ", "zz"]) + mixed + r.choice(["", " end", "\n"]))
    def fits(text, v, op):
        import itertools
        low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        variants = [" ".join(x) for x in itertools.product(*[[d + p[1:] for d in "-/–—―"] if p[:1] in "-/" and len(p) > 1 else [p] for p in v.split(" ")])]
        test = {"contains": str.__contains__, "startswith": str.startswith, "endswith": str.endswith, "": str.__eq__}[op]
        return any(test(low(text), low(x)) for x in variants)
    df = spark.createDataFrame([(i, json.dumps({"CommandLine": t})) for i, t in enumerate(rows)], "i int, raw string")
    for op in ("contains", "startswith", "endswith", ""):
        for v in values:
            rule = compile_rule({"title": "t", "detection": {"s": {f"CommandLine|windash{'|' * bool(op)}{op}": v}, "condition": "s"}})[0]
            got = {x.i for x in df.where(rule.predicate(F.col("raw"))).collect()}
            assert got == {i for i, t in enumerate(rows) if fits(t, v, op)}, (op, v)
    assert len(windash("x -a -b -c -d")) == 5**4


def test_networks(spark):
    """Addresses of both kinds in networks of all lengths, as a library for addresses has it."""
    import ipaddress

    r = random.Random(2)
    texts = ["", "x", "1.2.3", "256.1.1.1", "1.2.3.4", "10.0.0.1", "::", "::1", "fe80::1", "FE80::ABCD:1", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.400", "12345::", ":1", "1:", "1:2:3:4:5:6:7", "g::1", None]
    texts += [str(ipaddress.ip_address(r.getrandbits(32))) for _ in range(30)] + [str(ipaddress.IPv6Address(r.getrandbits(128))) for _ in range(30)] + [str(ipaddress.IPv6Address(r.getrandbits(16) << r.choice([0, 60, 112]))) for _ in range(30)]

    def address(t):
        try:
            return ipaddress.ip_address(t)
        except ValueError:
            return None

    good = [a for t in texts if t is not None and (a := address(t))]
    df = spark.createDataFrame([(i, json.dumps({"Ip": t})) for i, t in enumerate(texts)], "i int, raw string")
    for length in (0, 8, 32, 64, 65, 128):
        some = [ipaddress.ip_network(f"{a}/{min(length, a.max_prefixlen)}", strict=False) for a in r.sample(good, 8)]
        rule = compile_rule({"title": "t", "detection": {"s": {"Ip|cidr": [str(n) for n in some]}, "condition": "s"}})[0]
        got = {x.i for x in df.where(rule.predicate(F.col("raw"))).collect()}
        assert got == {i for i, t in enumerate(texts) if t is not None and (a := address(t)) and any(a.version == n.version and a in n for n in some)}, length
    assert df.where(~rule.predicate(F.col("raw"))).count() == len([t for t in texts if t is not None]) - len(got)


def test_upload_is_whole_and_recompiles(spark):
    c = Catalog()
    one, two = c.create_ruleset("one").path, c.create_ruleset("two").path
    lists = "name: tools\ndescription: what they run\nvalues: [{}]\n---\n"
    rule = "title: {0}\nid: {0}\ndetection: {{s: {{Image|expand: '%tools%'}}, condition: s}}\n"
    got = c.upload(one, lists.format("a.exe") + rule.format("r1"))
    assert got["saved"] == ["r1"] and got["recompiled"] == [] and c.lists.get("tools").description == "what they run"
    before = json.dumps([s.docs for s in c.sets.values()]), c.lists.values("tools")
    for bad in ("title: x\n", rule.format("r3").replace("tools", "missing"), "title: z\nid: z\ncorrelation: {type: odd}\n"):
        with pytest.raises(RuleError):
            c.upload(two, lists.format("b.exe") + rule.format("r2") + "---\n" + bad)
        assert (json.dumps([s.docs for s in c.sets.values()]), c.lists.values("tools")) == before and list(c.sets[two].compiled) == []
    got = c.upload(two, lists.format("b.exe, c.exe") + rule.format("r2") + "---\n" + rule.format("r1"))
    assert got["saved"] == ["r2"] and got["skipped"] == ["r1"] and got["owners"] == {"r1": one} and got["recompiled"] == ["r1"] and got["failed"] == {} and got["lists"]["updated"] == ["tools"]


def test_routes_and_packs(spark):
    rules = compile_rule({"id": "p", "title": "P", "level": "high", "logsource": {"category": "process_creation"}, "detection": {"s": {"Image|endswith": "\\evil.exe"}, "condition": "s"}})
    assert [(r.title, r.eventid, r.id) for r in rules] == [("P (Sysmon)", (1,), "p"), ("P (Security)", (4688,), "p")]
    rows = [("1", "1", {"Channel": rules[0].channel[0], "Image": "C:\\evil.exe"}), ("2", "4688", {"Channel": "Security", "NewProcessName": "D:\\EVIL.exe"}), ("3", "4688", {"Image": "C:\\evil.exe"}), ("4", "1", {"Image": "C:\\evil.exe"})]
    df = spark.createDataFrame([(i, c, json.dumps(e)) for i, c, e in rows], "event_id string, event_code string, raw string")
    assert {(r.event_id, r.rule_title) for r in M.matches(M.match(df, rules)).collect()} == {("1", "P (Sysmon)"), ("2", "P (Security)"), ("4", "P (Sysmon)")}
    many = [Rule(f"r{i}", f"R{i}", detection={"s": {"Image|endswith": f"\\evil{'' if i == 7 else i}.exe"}, "condition": "s"}) for i in range(120)] + [Rule("x", "X", detection={"s": {"Image|contains": "EVIL"}, "condition": "s"})]
    for joined in (True, False):
        got = {r.event_id: sorted(r.matched_rules) for r in M.match(df, many, pack=50, join_literals=joined).collect()}
        assert got == {"1": ["R7", "X"], "2": [], "3": ["R7", "X"], "4": ["R7", "X"]}
    assert M.match(df, []).where("is_matched").count() == 0 and M.match(df, many[:3]).where("is_matched").count() == 0


PACK = """
title: Base fail
id: b-1
name: base_fail
detection: {s: {EventID: 4625}, condition: s}
---
title: Base ok
id: b-2
detection: {s: {EventID: 4624}, condition: s}
---
title: Burst
id: c-1
name: burst
level: medium
correlation: {type: event_count, rules: base_fail, group-by: user, timespan: 5m, condition: {gte: 10}}
---
title: Chain
id: c-2
level: high
correlation: {type: temporal_ordered, rules: [burst, b-2], group-by: [user], timespan: 1h}
---
title: Lost
correlation: {type: temporal, rules: [nobody], group-by: [user], timespan: 1h}
---
name: admins
values: [" root ", admin, root, ""]
"""


def test_catalogue():
    c = Catalog()
    path = c.create_ruleset("My Set").path
    done = c.upload(path, PACK)
    assert len(done["saved"]) == 5 and done["lists"]["created"] == ["admins"] and c.lists.values("admins") == ["root", "admin"]
    assert c.upload(path, PACK.split("---")[0])["skipped"] == ["b-1"]
    found = {x.title: x for x in c.sets[path].correlations}
    assert set(found) == {"Burst", "Chain"} and found["Chain"].base_rules == (("Burst", "correlation"), ("Base ok", "rule")) and found["Burst"].timespan == 300
    assert c.status(path) == "none" and c.main() == []
    c.toggle_ruleset(path, True)
    assert c.status(path) == "full" and {x.title for x in c.main_correlations()} == {"Burst", "Chain"}
    c.toggle_rule(path, "b-2", False)
    assert c.status(path) == "partial" and [r.id for r in c.main()] == ["b-1"] and not c.is_included(path, "b-2")
    c.toggle_rule(path, "b-2", True)
    assert c.status(path) == "full"
    with pytest.raises(RuleError):
        c.save_rule(path, {"id": "b-1", "title": "Other", "detection": {"s": {"a": 1}, "condition": "s"}})
    with pytest.raises(RuleError):
        c.save_rule(path, {"title": "Base ok", "detection": {"s": {"a": 1}, "condition": "s"}})
    with pytest.raises(RuleError):
        c.update_rule(path, "b-1", {"id": "other", "title": "x", "detection": {"s": {"a": 1}, "condition": "s"}})
    c.update_rule(path, "b-1", {"title": "Base fail", "detection": {"s": {"u|expand": "%admins%"}, "condition": "s"}})
    assert c.list_usage() == {"admins": 1} and c.change_list("admins", ["x"]) == {}
    builtin = c.load_compiled("builtin.json", [{"id": "z", "title": "Z", "level": "critical", "detection": {"s": {"a": 1}, "condition": "s"}}])
    assert [r["builtin"] for r in c.rulesets()] == [False, True] and builtin.rules[0].level == "critical"
    with pytest.raises(RuleError):
        c.load_compiled("bad.json", {"a": 1})
    assert c.get_rule(path, "b-1") and c.delete_rule(path, "b-1") and not c.get_rule(path, "b-1") and c.owner("z") == "builtin.json"
    assert c.delete_ruleset(path) and c.main() == []


def test_search_rules():
    rules = [Rule(str(i), f"Rule {i}", lvl, status="test" if i % 2 else "stable") for i, lvl in enumerate(["low", "high", "critical", "medium"])]
    n, page = search_rules(rules, "rule", sort_by="level", descending=True, limit=2)
    assert n == 4 and [r["level"] for r in page] == ["critical", "high"]
    assert search_rules(rules, level={"low"}, status={"stable"})[0] == 1 and search_rules(rules, ids={"3"})[1][0]["title"] == "Rule 3" and search_rules(rules, "none")[0] == 0


@pytest.mark.parametrize("change", [{"type": "value_sum"}, {"rules": []}, {"group-by": []}, {"timespan": "5y"}, {"condition": None}, {"condition": {"field": "x"}}, {"condition": "a and b"}, {"type": "value_count", "condition": {"gte": 1}}])
def test_bad_correlations(change):
    good = {"type": "event_count", "rules": ["a"], "group-by": ["u"], "timespan": "5m", "condition": {"gte": 3}}
    assert check_correlation({"correlation": good})
    with pytest.raises(RuleError):
        check_correlation({"correlation": {**good, **change}})
    assert resolve_correlations([{"title": "t", "correlation": good}]) == []


def test_literals_of_several_kinds(spark, monkeypatch):
    """Rules of numbers, booleans, whole texts and endings, for any event id or some: joined, shuffled and as predicates alike."""
    rows = [("1", "1", {"n": 5, "Image": "C:\\a\\b.EXE", "flag": True}), ("2", "2", {"n": "5", "Image": "b.exe"}), ("3", "1", {"n": 5.5, "flag": "true"}), ("4", None, {"n": 1.50}), ("5", "1", {})]
    df = spark.createDataFrame([(i, c, json.dumps(e)) for i, c, e in rows], "event_id string, event_code string, raw string")
    d = lambda s: {"s": s, "condition": "s"}
    rules = [
        Rule("a", "A", detection=d({"n": [5, 7]})), Rule("b", "B", eventid=(1, 3), detection=d({"n": [5, 5.5]})), Rule("c", "C", detection=d({"flag": True})), Rule("d", "D", detection=d({"Image|endswith": ["\\B.exe", "/x"]})),
        Rule("e", "E", detection=d({"Image": ["b.exe", "c:\\A\\b.exe"]})), Rule("f", "F", detection=d({"Image": None})), Rule("g", "G", detection=d({"n": "5*"})), Rule("h", "H", detection=d({"n": 1.5})),
    ]
    want = {"1": ["A", "B", "C", "D", "E", "G"], "2": ["A", "E", "G"], "3": ["B", "F", "G"], "4": ["F", "H"], "5": ["F"]}
    assert sum(M.literal_rows(r) is not None for r in rules) == 6
    for joined in (True, False):
        assert {r.event_id: r.matched_rules for r in M.match(df, rules, join_literals=joined).collect()} == want
    monkeypatch.setattr(M, "BROADCAST_LITERALS", 0)
    assert {r.event_id: r.matched_rules for r in M.match(df, rules).collect()} == want


def test_logsources(spark):
    d = {"s": {"a": 1}, "condition": "s"}
    made = lambda **source: [(r.title, r.channel, r.eventid) for r in compile_rule({"title": "t", "detection": d, "logsource": source})]
    assert made(service="security") == [("t", ("Security",), ())] and made(service="auditd", product="linux") == [("t", (), ())]
    assert made(category="process_creation", product="linux") == [("t", (), ())] and made(category="process_creation", service="sysmon")[0][2] == (1,)
    assert [x[0] for x in made(category="pipe_created", product="windows")] == ["t (Sysmon 17)", "t (Sysmon 18)"] and made(category="nothing") == [("t", (), ())]


def test_a_catalogue_on_disk(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "catalogue"), CATALOG)
    assert Catalog.load(table).rulesets() == []
    c = Catalog()
    path = c.create_ruleset("My Set").path
    c.upload(path, PACK)
    c.save_rule(path, {"id": "x", "title": "X", "detection": {"s": {"u|expand": "%admins%"}, "condition": "s"}})
    c.toggle_ruleset(path, True)
    c.toggle_rule(path, "b-2", False)
    c.save(table)
    again = Catalog.load(table)
    assert again.rulesets() == c.rulesets() and [r.id for r in again.main()] == [r.id for r in c.main()] and again.lists.all() == c.lists.all() and again.list_usage() == {"admins": 1}
    assert {x.title for x in again.main_correlations()} == {"Burst", "Chain"} and not again.is_included(path, "b-2")
    # A list without values leaves the rule as it was, and tells.
    assert set(again.change_list("admins", [])) == {"x"} and [r.id for r in again.main()] == [r.id for r in c.main()]
    (tmp_path / "set.json").write_text(json.dumps([{"id": "z", "title": "Z", "detection": {"s": {"a": 1}, "condition": "s"}}]))
    one = again.load_compiled_file(spark, str(tmp_path / "set.json"))
    assert again.load_compiled_file(spark, str(tmp_path / "set.json")) is one and one.rules[0].id == "z"
    (tmp_path / "set.json").write_text("{}")
    with pytest.raises(RuleError):
        again.load_compiled_file(spark, str(tmp_path / "set.json"))
    (tmp_path / "rules").mkdir()
    for i, part in enumerate(PACK.split("---")):
        (tmp_path / "rules" / f"{i}.yml").write_text(part)
    assert {x.title for x in load_correlations(spark, str(tmp_path / "rules"))} == {"Burst", "Chain"}


def test_packs_with_pipelines_and_bad_lists():
    c = Catalog()
    path = c.create_ruleset("s").path
    pack = "name: My pipeline\ntransformations:\n- type: value_placeholders\n  mapping: {tools: [a.exe, b.exe]}\n---\ntitle: T\nid: t-1\ndetection: {s: {Image|expand: '%tools%'}, condition: s}\n"
    done = c.upload(path, pack)
    assert done["saved"] == ["t-1"] and c.lists.values("tools") == ["a.exe", "b.exe"]
    c.upload(path, pack.replace("b.exe", "c.exe"))
    assert c.lists.values("tools") == ["a.exe", "c.exe"]
    assert parse_lists("name: n\nvalues: [a, b]\n---\nn: [b, c]\nm: 1\n") == {"n": ["a", "b", "c"], "m": ["1"]}
    for bad in ("a b: [1]", "transformations: [{type: other}]", "n: {a: 1}", "", "- 1", "detection: {}", "x: [1"):
        with pytest.raises(ListError):
            parse_lists(bad)
    with pytest.raises(RuleError):
        c.save_rule(path, {"id": "q", "correlation": {"type": "event_count", "rules": ["a"], "group-by": ["u"], "timespan": "5m", "condition": {"gte": 3}}})


def test_value_lists():
    v = ValueLists()
    made = v.create("a_1", [" x ", "x", "", None, 5], "d")
    assert made.values == ["x", "5"] and v.get("a_1").description == "d"
    for bad in ("", "a b", "x" * 65, "a_1"):
        with pytest.raises(ListError):
            v.create(bad, ["1"])
    with pytest.raises(ListError):
        v.create("big", map(str, range(3)) and [str(i) for i in range(20_001)])
    assert v.update("a_1", ["z"]).created_at == made.created_at
    assert v.load({"a_1": ["q"], "b": ["1"]})["skipped"] == ["a_1"] and v.load({"a_1": ["q"]}, "merge")["updated"] == ["a_1"] and v.values("a_1") == ["z", "q"]
    assert v.load({"a_1": ["w"]}, "replace") and v.values("a_1") == ["w"] and [x.name for x in v.all()] == ["a_1", "b"] and v.delete("b") and not v.delete("b")
    pipeline = "transformations:\n- type: value_placeholders\n  mapping: {p: [1, 2], q: z}\n"
    assert parse_lists(pipeline) == {"p": ["1", "2"], "q": ["z"]} and parse_lists("name: n\nvalues: [a]\n---\nname: m\nvalues: [b]\n") == {"n": ["a"], "m": ["b"]} and parse_lists("k: [v]") == {"k": ["v"]}
    with pytest.raises(ListError):
        parse_lists(PACK.split("---")[0])
    assert [is_list_document(d) for d in documents(PACK)] == [False] * 5 + [True]
