"""Quality rules: a fixed base, then a decision list learned from labels.

All counts of a text are Catalyst expressions over arrays within its row: no
word is shuffled, and no Python runs on executors. The list is learned by
sequential covering. Each feature is a whole number, so that what a step needs
of the labelled rows is a histogram of feature, value and label, made by one
aggregation and bounded by features times values. From it a condition is
chosen, by FOIL's gain, until the conjunction holds no good row; conditions
that don't pay on other rows are pruned; rows that a rule covers leave, and
the next one is grown. What comes out is an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stage

#: Highest value of a feature; greater ones count as this one.
TOP = 1000
#: Labelled rows that are used for learning, about, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 1_000_000
FEATURES = ("words", "chars_per_word", "symbols", "capitals", "digits", "marks", "repeat_words", "distinct_words", "dup_lines")


@dataclass(frozen=True)
class Condition:
    """feature <= value, or feature >= value."""

    feature: str
    up: bool
    value: int

    def column(self) -> Column:
        f = F.col(self.feature)
        return f >= self.value if self.up else f <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.up else '<='} {self.value}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def counted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, the counts of each whole text, and the features, whole numbers from 0 to TOP.

    docs: text and those. A null text has no words. words, chars_per_word (in
    tenths), and thousandths: symbols, capitals, digits and marks ([!?]) of
    characters in words, repeat_words and distinct_words of words, dup_lines of
    lines. A text's words are held at once, at about 200 bytes each.
    """
    t = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t_"))
    # Every column that a lambda reads is read more than once, so that no plan puts its expression into the lambda.
    t = t.select(*keep, "t_", F.regexp_extract_all("t_", F.lit(WORD), F.lit(0)).alias("w_"), F.regexp_replace("t_", r"[\p{Ll}\x20\x09-\x0D]+", "").alias("rest_"), F.filter(F.split("t_", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines_"))
    at = F.sequence(F.lit(0), F.size("w_") - 3)
    hashes = F.when(F.size("w_") >= 3, F.transform(at, lambda i: F.xxhash64(F.get("w_", i), F.get("w_", i + 1), F.get("w_", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    count = lambda kept: F.length(F.regexp_replace("rest_", f"[^{kept}]+", "")).cast("bigint")
    t = t.select(
        *keep, F.size("w_").cast("bigint").alias("n_words"), F.length(F.array_join("w_", "")).cast("bigint").alias("word_chars"), count(r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("bigint").alias("n_dup_lines"), F.size("lines_").cast("bigint").alias("n_lines"),
        count(r"\p{Lu}").alias("n_capitals"), count("0-9").alias("n_digits"), count("!?").alias("n_marks"), F.size(F.array_distinct("w_")).cast("bigint").alias("n_distinct"), hashes.alias("h_"),
    )
    # Windows by hash and place; equal ones are neighbours.
    places = F.when(F.size(F.array_distinct("h_")) < F.size("h_"), F.sort_array(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    t = t.withColumn("s_", places).drop("h_")
    near = lambda i: F.get("s_", i)["h"]
    again = F.filter("s_", lambda x, i: (x["h"] == F.when(i > 0, near(i - 1))) | (x["h"] == near(i + 1)))
    t = t.withColumn("a_", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s_")
    # A repeated window adds those of its three words that the next one doesn't begin before.
    added = F.transform("a_", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("a_", i + 1) - p, F.lit(3))))
    t = t.withColumn("n_repeat_words", F.coalesce(F.aggregate(added, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("bigint")).drop("a_")
    share = lambda a, b, times=1000: F.coalesce(F.least(F.lit(TOP), F.expr(f"({times} * {a}) div nullif({b}, 0)")), F.lit(0)).cast("int")
    features = {
        "words": F.least(F.lit(TOP), F.col("n_words")).cast("int"), "chars_per_word": share("word_chars", "n_words", 10), "symbols": share("n_symbols", "word_chars"), "capitals": share("n_capitals", "word_chars"),
        "digits": share("n_digits", "word_chars"), "marks": share("n_marks", "word_chars"), "repeat_words": share("n_repeat_words", "n_words"), "distinct_words": share("n_distinct", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"),
    }
    return t.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f.alias(k) for k, f in features.items()])


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _best(counts: list[tuple[str, int, int, int]], p: int, n: int, least: int) -> tuple[float, Condition | None, int, int]:
    """The condition with the highest gain: gain, condition, and the bad and good rows that it leaves. counts: feature, value, bad, good rows. Ties go to the first by feature and value."""
    best: tuple[float, Condition | None, int, int] = (0.0, None, p, n)
    by: dict[str, list[tuple[int, int, int]]] = {}
    for f, v, a, b in sorted(counts):
        by.setdefault(f, []).append((v, a, b))
    before = math.log2(p / (p + n))
    for f, values in by.items():
        for up in (False, True):
            a = b = 0
            some = values[::-1] if up else values
            for (v, x, y), (beyond, _, _) in zip(some, some[1:], strict=False):
                a, b = a + x, b + y
                if a >= least:
                    gain = a * (math.log2(a / (a + b)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, up, (v + beyond) // 2 + (1 if up else 0)), a, b)
    return best


def learn(rows: DataFrame, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """Rules that cover bad rows, in order.

    rows: FEATURES, bad (boolean) and prune (boolean: rows that prune and judge,
    instead of growing). A rule stays if, of the rows that judge it, precision or more
    are bad, with one bad row or more; the first that doesn't ends the list.
    A grown rule has least bad rows or more. A threshold lies halfway between
    two values of rows. The same rows give the same list, in whatever order and partitions.
    """
    rules: list[Rule] = []
    shape = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("x")
    while len(rules) < max_rules:
        left = rows.where(~reduce(lambda a, b: a | b, map(holds, rules), F.lit(False)))
        grow, rule = left.where(~F.col("prune")), ()
        while len(rule) < max_conditions:
            hist = grow.where(holds(rule)).select("bad", shape).groupBy("x.feature", "x.value").agg(F.count_if("bad").alias("a"), F.count_if(~F.col("bad")).alias("b")).collect()
            counts = [(r["feature"], r["value"], r["a"], r["b"]) for r in hist]
            p, n = (sum(c[k] for c in counts if c[0] == FEATURES[0]) for k in (2, 3))
            if p < least or not n:
                break
            gain, condition, p, n = _best(counts, p, n, least)
            if condition is None:
                break
            rule += (condition,)
        if not rule:
            break
        # Of the rule's heads, the one that gains most on other rows; a shorter one if they are even.
        heads = [rule[:i] for i in range(1, len(rule) + 1)]
        got = left.where("prune").agg(*[F.count_if(holds(h) & F.col("bad")).alias(f"p{i}") for i, h in enumerate(heads)], *[F.count_if(holds(h) & ~F.col("bad")).alias(f"n{i}") for i, h in enumerate(heads)]).first()
        value = [(got[f"p{i}"] - got[f"n{i}"]) / max(1, got[f"p{i}"] + got[f"n{i}"]) for i in range(len(heads))]
        i = value.index(max(value))
        p, n = got[f"p{i}"], got[f"n{i}"]
        if not p or p < precision * (p + n):
            break
        rules.append(heads[i])
    return rules


def first_rule(rules: list[Rule]) -> Column:
    """The number, from 1 on, of the first rule that holds; null if none does: one conditional expression."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(holds(r), F.lit(i)).otherwise(out)
    return out


def labelled(counts: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """What learn() takes, of the labelled rows of counts that the base keeps.

    A label of 0 is bad; a doc_id with several has the least; null ids and
    labels take no part. A third of ids, by hash, prunes. Of more than about rows
    labelled ids, those with the smallest hashes are taken.
    """
    some = labels.select("doc_id", F.col(label).alias("y_")).where("doc_id is not null and y_ is not null").groupBy("doc_id").agg((F.min("y_") == 0).alias("bad"))
    some = some.withColumn("u_", F.conv(F.substring(F.sha2(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("bigint"))
    n = some.count()
    if n > rows:
        some = some.where(F.col("u_") < int(rows / n * (1 << 32)))
    return counts.where(~base_failed()).join(some, "doc_id").select(*FEATURES, "bad", (F.col("u_") % 3 == 0).alias("prune"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rule of every row.

    docs: doc_id, text. Null, empty and short texts fail the base. kept is false if
    the base fails or a rule of the learned list holds; rule is the first
    one's number. Equal rows are judged alike, each by itself; null ids, too. Without
    labels, or of one kind only, the list is empty.
    """
    counts = stage(counted(docs), "counted")
    rules = learn(stage(labelled(counts, labels), "labelled"), **options)
    out = counts.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), first_rule(rules)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
