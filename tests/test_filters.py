"""The filter language against SQLite on loosely typed values."""

from __future__ import annotations

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from logwarden.functions import jsontext as J
from logwarden.plans.filters import Condition, FilterError, Join, Not, as_number, compile_filter, compile_tree, drill_in, parse

VALUES = [True, False, 0, 1, 7, -3, 1.5, 2.50, 1e3, "", "0", "1", "7", "7abc", " 12", "true", "Ünï", "Привет", "HELLO", "hello", "a%b", "a_b", "x\\y", None, {"k": 1}, [1, 2]]
FIELDS = ["a", "b", "c.d"]
OPS = ["eq", "neq", "contains", "gt", "lt", "gte", "lte", "in", "isnull", "notnull"]
LITERALS = ["", "0", "1", "7", "1.5", "2.5", "1000", "-3", "hello", "HEL", "прив", "Прив", "%", "_", "\\", "true", "abc", "nan", "inf", "1_0"]


def rows(r: random.Random, n: int = 60) -> list[str]:
    out = []
    for _ in range(n):
        e = {f: r.choice(VALUES) for f in FIELDS if r.random() < 0.85}
        out.append(json.dumps(e, ensure_ascii=False))
    return out


def tree(r: random.Random, depth: int = 3):
    if depth and r.random() < 0.5:
        return Join(r.choice(["and", "or"]), tuple(tree(r, depth - 1) for _ in range(r.randint(2, 3))))
    if depth and r.random() < 0.3:
        return Not(tree(r, depth - 1))
    op = r.choice(OPS)
    value = [r.choice(LITERALS) for _ in range(2)] if op == "in" else None if op in ("isnull", "notnull") else r.choice(LITERALS)
    return Condition(r.choice(FIELDS), op, value)


def sqlite(node) -> tuple[str, list]:
    if isinstance(node, Join):
        parts = [sqlite(p) for p in node.parts]
        return "(" + f" {node.word} ".join(p[0] for p in parts) + ")", [x for p in parts for x in p[1]]
    if isinstance(node, Not):
        q, p = sqlite(node.part)
        return f"(not {q})", p
    x, t = f"json_extract(raw, '$.\"{node.field}\"')", f"cast(json_extract(raw, '$.\"{node.field}\"') as text)"
    v = node.value
    if node.op == "isnull":
        return f"{x} is null", []
    if node.op == "notnull":
        return f"{x} is not null", []
    if node.op == "eq":
        return f"{t} = ?", [v]
    if node.op == "neq":
        return f"({x} is null or {t} != ?)", [v]
    if node.op == "in":
        return f"{t} in (?, ?)", v
    if node.op == "contains":
        return f"{t} like ? escape '!'", ["%" + v.replace("!", "!!").replace("%", "!%").replace("_", "!_") + "%"]
    sign = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<="}[node.op]
    n = as_number(v)
    return (f"{t} {sign} ?", [v]) if n is None else (f"cast({x} as real) {sign} ?", [n])


def test_random_trees_match_sqlite(spark):
    r = random.Random(20)
    data = rows(r)
    con = sqlite3.connect(":memory:")
    con.execute("create table t(i integer, raw text)")
    con.executemany("insert into t values (?, ?)", list(enumerate(data)))
    df = spark.createDataFrame(list(enumerate(data)), "i long, raw string").coalesce(1)
    trees = [tree(r) for _ in range(40)] + [Condition(f, op, v) for f in ("a",) for op in ("gt", "lte", "contains", "eq") for v in LITERALS]
    marks = df.select("i", *[F.coalesce(compile_tree(t), F.lit(False)).alias(f"t{k}") for k, t in enumerate(trees)]).collect()
    for k, t in enumerate(trees):
        q, p = sqlite(t)
        want = {x[0] for x in con.execute(f"select i from t where {q}", p)}
        assert {m.i for m in marks if m[f"t{k}"]} == want, t


@pytest.mark.parametrize("text, want", [
    ("a = 1", Condition("a", "eq", "1")),
    ("a=1 or b<>2 and not c is null", Join("or", (Condition("a", "eq", "1"), Join("and", (Condition("b", "neq", "2"), Not(Condition("c", "isnull"))))))),
    ("(A CONTAINS 'x \\' y')", Condition("A", "contains", "x ' y")),
    ('a in ("p q", r)', Condition("a", "in", ["p q", "r"])),
    ("a IS NOT NULL", Condition("a", "notnull")),
    ("  ", None),
])
def test_parse(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["a", "a =", "= 1", "(a = 1", "a = 1)", "a in 1", "a in (1", "a is nul", "a ! 1", "and = 1", "a = 1 b = 2", "a in ()", '"a" = 1', "a = 'x"])
def test_errors_have_positions(text):
    with pytest.raises(FilterError, match="position"):
        parse(text)


def test_pseudo_field_errors(spark):
    for text in ("is_matched > 1", "is_matched = perhaps", "rule > x"):
        with pytest.raises(FilterError):
            compile_filter(text)
    assert compile_filter(" ") is None
    with pytest.raises(FilterError):
        compile_tree(Condition("a", "like", "x"))
    df = spark.createDataFrame([('{"a": "1"}',)], "raw string")
    assert df.where(drill_in([{"field": "a", "value": "1"}, {"field": "", "value": "2"}, {"field": "a", "op": "bad", "value": "2"}])).count() == 1


def test_presence_and_order(spark):
    cases = [('{"f": "0"}', "0"), ('{"f": 0}', None), ('{"f": 0.0}', None), ('{"f": false}', None), ('{"f": true}', "True"), ('{"f": ""}', None), ('{"f": []}', None), ('{"f": {}}', None), ('{"f": "[]"}', "[]"), ('{"f": 5}', "5"), ('{"g": 1}', None), ('{"f": null}', None), ('{"f": "true"}', "true")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, raw string")
    got = {r.i: r.v for r in df.select("i", J.present(F.col("raw"), "f").alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    order = [r.raw for r in spark.createDataFrame([('{"f": "b"}',), ('{"f": 10}',), ('{"f": 9}',), ("{}",), ('{"f": "a"}',)], "raw string").orderBy(*J.order_rank(F.col("raw"), "f")).collect()]
    assert order == ["{}", '{"f": 9}', '{"f": 10}', '{"f": "a"}', '{"f": "b"}']
