from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logwarden.llm import repair

COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(rows):
    """(cost, audit, turns) by trying all edits. rows: (role, text, fault)."""
    best = None
    for inserts in range(5):
        for reads in itertools.product("KRD", repeat=len(rows)):
            for places in itertools.combinations(range(len(rows) + inserts), inserts):
                it, audit = iter(reads), []
                for i in range(len(rows) + inserts):
                    audit.append("I" if i in places else next(it))
                cost, at, choices, bad = 0, 0, [], False
                for a in audit:
                    cost += COSTS[a]
                    if a == "I":
                        choices.append([("user", ""), ("assistant", "")])
                        continue
                    role, text, fault = rows[at]
                    at += 1
                    if a == "D":
                        continue
                    bad |= fault in ("blank", "duplicate")
                    cost += fault == "truncated"
                    choices.append([(role, text)] if a == "K" else [("user", text), ("assistant", text)])
                if bad or (best and (cost, "".join(audit)) >= best[:2]):
                    continue
                for turns in itertools.product(*choices):
                    if all(r for r, _ in turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)):
                        best = cost, "".join(audit), list(turns)
                        break
    return best


def suffixes(rows):
    """(cost, audit) by least suffixes from the end: strings are compared as wholes."""
    take = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    relax = lambda v: [min([v[q]] + [(2 + v[t][0], "I" + v[t][1]) for x, t in take[q].items() if x != "s"]) for q in range(4)]
    closed = lambda v: relax(relax(relax(v)))
    v = closed([(0, ""), (99, ""), (99, ""), (0, "")])
    for role, _, fault in reversed(rows):
        w = []
        for q in range(4):
            ways = [(3 + v[q][0], "D" + v[q][1])]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                ways += [(more + v[t][0], "K" + v[t][1]) for x, t in take[q].items() if x == role[:1]]
                ways += [(2 + more + v[t][0], "R" + v[t][1]) for x, t in take[q].items() if x != "s"]
            w.append(min(ways))
        v = closed(w)
    return v[0]


def faulty(rows):
    """(role, text, fault) of a conversation's (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def damaged(turns):
    """{conv_id: ordered (turn, role, text)}; every conversation has an entry."""
    out = {}
    for conv, turn, role, text in turns:
        rows = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def report(conv, rows):
    marked = faulty(rows)
    turns = [t for t, _, _ in rows if t is not None]
    kinds = [f for _, _, f in marked]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = suffixes(marked)
    left, state, parts = iter(marked), 0, []
    for a in audit:
        role, text, _ = ("", "", "") if a == "I" else next(left)
        if a == "D":
            continue
        if a != "K":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        parts.append(f"{role}:{text}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest()


def run(df):
    return repair.conversation_reports(repair.repair(repair.damage(df)))


def compare(df, turns):
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted((report(c, r) for c, r in damaged(turns).items()), key=str)


def codes_of(rows):
    faults = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
    return bytes(4 * max(0, "-sua".find(r[:1] or "-")) + faults[f] for r, _, f in rows)


def test_against_all_edits():
    r = random.Random(0)
    net = repair.Composition()
    for _ in range(150):
        rows = [(r.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), f"t{i}", r.choice(["", "", "", "truncated", "blank", "duplicate"])) for i in range(r.randint(0, 4))]
        cost, audit, turns = exhaustive(rows)
        got = net.solve([codes_of(rows)])
        assert (got[0], got[1][0]) == (cost, audit) == suffixes(rows)
        kept = [(a, b) for a, b, f in rows if f not in ("blank", "duplicate")]
        roles, texts, total, _ = repair.edited(codes_of(rows), audit, [x[0] for x in kept], [x[1] for x in kept])
        assert list(zip(roles, texts)) == turns and total == cost


@pytest.mark.parametrize("seed", range(5))
def test_long_ones_against_least_suffixes(seed):
    """Appending doesn't keep the order of label strings of different lengths; wholes are compared here."""
    r = random.Random(seed)
    net = repair.Composition()
    for _ in range(60):
        rows = [(r.choice(["user", "user", "assistant", "system", "x"]), f"t{i}", r.choice(["", "", "truncated", "blank", "duplicate"])) for i in range(r.randint(0, 60))]
        codes = codes_of(rows)
        cut = sorted(r.randint(0, len(codes)) for _ in range(3))
        pieces = [codes[a:b] for a, b in zip([0, *cut], [*cut, len(codes)])]
        cost, parts = net.solve(pieces)
        assert (cost, "".join(parts)) == suffixes(rows) == (net.solve([codes])[0], net.solve([codes])[1][0])
        assert [len(p.replace("I", "")) for p in parts] == [len(p) for p in pieces]


def test_table_against_brute_force(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = run(c)
    assert dict(out.dtypes) == dict.fromkeys(("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint") | {"audit": "string", "repaired_sha256": "string"}
    compare(out, [(r.conv_id, r.turn, r.role, r.text) for r in c.collect()])


def odd_turns():
    r = random.Random(1)
    texts = [None, "", " \n", "Yes.", "no", "What?", "Yes. ", "a\x1c.", "Ünï!", "z" * 3000]
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, 0, 1, 2, 3, 7, -2]), r.choice([None, "", "user", "assistant", "system", "tool"]), r.choice(texts)) for _ in range(400)]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + rows[:50] + [(dropped, 0, "user", "All of it is dropped.")]


def test_nulls_ties_and_repeated_rows(spark):
    turns = odd_turns()
    df = spark.createDataFrame([(*t, "clash", "clash") for t in turns], SCHEMA + ", piece string, range string")
    compare(run(df), turns)
    compare(run(df.repartition(3)), turns)
    assert run(df.limit(0)).collect() == []


@pytest.mark.parametrize("rows, chars", [(3, 1 << 20), (1 << 16, 50)])
def test_conversations_in_pieces(spark, monkeypatch, rows, chars):
    """One conversation holds a third of all rows; it crosses ranges, and its pieces are small."""
    monkeypatch.setattr(repair, "PIECE_ROWS", rows)
    monkeypatch.setattr(repair, "PIECE_CHARS", chars)
    r = random.Random(2)
    said = ["user", "assistant", "user", "system"]
    turns = [(i % 40 if i % 3 else 1000, i, r.choice(said), r.choice(["Fine.", f"Number {i}.", f"cut {i}", ""])) for i in range(1200)] + odd_turns()
    compare(run(spark.createDataFrame(turns, SCHEMA)), turns)


def test_one_row_many_times(spark):
    """A third of all rows are one row."""
    turns = [(1, 5, "user", "Same.")] * 400 + [(2, i, "user" if i % 2 == 0 else "assistant", f"Text {i}.") for i in range(800)]
    compare(run(spark.createDataFrame(turns, SCHEMA)), turns)


def test_turns_that_are_left_are_the_output(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    pieces = repair.repair(repair.damage(df))
    left = repair.repaired_turns(pieces).orderBy("conv_id", "piece", "place").collect()
    want = {r.conv_id: r.repaired_sha256 for r in repair.conversation_reports(pieces).collect()}
    for conv, h in want.items():
        turns = [t for t in left if t.conv_id == conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == h


def test_long_texts(spark):
    df = spark.range(40).select((F.col("id") % 5).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.expr("concat(repeat('long text ', 300000), id, '.')").alias("text"))
    assert run(df.repartition(2)).count() == 5
