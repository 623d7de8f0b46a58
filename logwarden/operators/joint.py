"""Many correlations in one pass over a ledger of hits.

Rules with the same key fields share a stream: a hit goes there once, under its
key, whatever the number of rules. Behind that one shuffle, it meets each rule
that its title is in. What rules count, hits, distinct values or distinct titles,
is one running sum: a hit adds one at its time and takes it back when the
rule's span is over, or when its value comes again. So spans and
thresholds are data, no plan grows with the number of rules, and
time is linear in hits times the rules that they are in. A key's hits are
dealt by slices of time, so that a noisy one is many tasks.

Late hits: with new hits at hand, the anchors are these, and all stored hits
whose windows one of them lies in. So the order of arrival doesn't matter.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..plans.catalog import COUNT_OPS, Correlation, in_order
from .alerts import entity_sets
from .correlation import BROADCAST_KEYS

RULE = "g int, title_ string, rule int, span bigint, counts string, field string, places array<int>, steps int"
TEST = "rule_ int, names array<string>, ordered boolean, final string, least int, counted boolean, known boolean, " + ", ".join(f"{op} double" for op in COUNT_OPS)
#: Spans of time in a slice of a key's hits; one of so many hits is in two.
SLICE = 8
HEAD = "struct<id:string,title:string,level:string>"
#: Rows of rules that a task should sort.
TASK_ROWS = 250_000


def _number(value: object) -> float | None:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


@dataclass
class Rules:
    """Correlations as small tables: streams by title, and rules by stream and title."""

    correlations: list[Correlation]

    def __post_init__(self) -> None:
        self.streams = list(dict.fromkeys(c.group_by for c in self.correlations))

    @property
    def titles(self) -> list[str]:
        return sorted({t for c in self.correlations for t in c.titles})

    @property
    def reach(self) -> int:
        return max(c.timespan for c in self.correlations) * 1_000_000

    @property
    def steps(self) -> int:
        return max((len(c.titles) for c in self.correlations if c.kind == "temporal_ordered"), default=0)

    def stream_table(self, spark: SparkSession) -> DataFrame:
        rows = {(t, self.streams.index(c.group_by)): list(c.group_by) for c in self.correlations for t in c.titles}
        reach = {g: max(c.timespan for c in self.correlations if c.group_by == names) * 1_000_000 for g, names in enumerate(self.streams)}
        return spark.createDataFrame([(t, g, names, reach[g]) for (t, g), names in rows.items()], "title_ string, g int, names array<string>, reach bigint")

    def rule_table(self, spark: SparkSession) -> DataFrame:
        """What rules make of hits, by stream and title."""
        rows = []
        for i, c in enumerate(self.correlations):
            ordered = c.kind == "temporal_ordered"
            counts = {"event_count": "hits", "value_count": "values"}.get(c.kind, "titles")
            for t in dict.fromkeys(c.titles):
                places = [k for k, x in enumerate(c.titles) if x == t] if ordered else []
                rows.append((self.streams.index(c.group_by), t, i, c.timespan * 1_000_000, counts, c.distinct_field, places, len(c.titles) if ordered else 0))
        return spark.createDataFrame(rows, RULE)

    def test_table(self, spark: SparkSession) -> DataFrame:
        """What rules ask of counts."""
        rows = []
        for i, c in enumerate(self.correlations):
            bounds = [_number(c.condition.get(op)) for op in COUNT_OPS]
            counted = c.kind in ("event_count", "value_count") or any(k != "field" for k in c.condition)
            rows.append((i, list(c.group_by), c.kind == "temporal_ordered", c.titles[-1], len(set(c.titles)), counted, any(b is not None for b in bounds), *bounds))
        return spark.createDataFrame(rows, TEST)

    def head(self, rule: Column) -> Column:
        """The id, title and level of a rule by its number."""
        said = [{"id": c.id, "title": c.title, "level": c.level} for c in self.correlations]
        return F.get(F.from_json(F.lit(json.dumps(said)), f"array<{HEAD}>"), rule)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def _streams(hits: DataFrame, rules: Rules) -> DataFrame:
    """Hits under the keys of each stream that has their title; those without all parts of a key, or a time, are left out."""
    table = rules.stream_table(hits.sparkSession)
    some = hits.where(F.col("rule_title").isin(rules.titles)).join(_small(table, len(rules.titles) * len(rules.streams)), F.col("rule_title") == F.col("title_"))
    keys = F.lit(None).cast("array<string>")
    for g, names in enumerate(rules.streams):
        keys = F.when(F.col("g") == g, F.array(*[F.try_element_at("group_values", F.lit(n)) for n in names])).otherwise(keys)
    rows = some.select("event_id", "rule_title", "source_batch", "event_ts", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("at_us"), "group_values", "g", "names", "reach", keys.alias("keys"))
    return rows.where(F.col("at_us").isNotNull() & (F.size(F.array_compact("keys")) == F.size("names")))


def _moment(us: int) -> Column:
    return F.lit(datetime(1970, 1, 1) + timedelta(microseconds=us)).cast("timestamp_ntz")


def _touched(hits: DataFrame, new: DataFrame, rules: Rules) -> DataFrame | None:
    """Rows of the streams that windows of new hits, or of hits that these are in the windows of, can see, with fresh; None if nothing is new. The bounds of all of it reach the file scan."""
    fresh = _streams(new, rules)
    per_key = fresh.groupBy("g", "source_batch", "keys").agg((F.min("at_us") - F.max("reach")).alias("low"), (F.max("at_us") + F.max("reach")).alias("high"), F.count("*").alias("n"))
    keys, low, high, n = per_key.agg(F.count("*"), F.min("low"), F.max("high"), F.sum("n")).first()
    if not keys:
        return None
    rows = _streams(hits.where(F.col("event_ts").between(_moment(low), _moment(high))), rules)
    seen = per_key.select(F.col("g").alias("g_"), F.col("source_batch").alias("batch_"), F.col("keys").alias("keys_"), "low", "high")
    same = [F.col("g") == F.col("g_"), F.col("source_batch").eqNullSafe(F.col("batch_")), F.col("keys") == F.col("keys_"), F.col("at_us").between(F.col("low"), F.col("high"))]
    rows = rows.join(_small(seen, keys), same).select(rows.columns)
    ids = fresh.select(F.col("event_id").alias("id_"), F.col("rule_title").alias("of_")).distinct()
    marked = rows.join(_small(ids, n), (F.col("event_id") == F.col("id_")) & (F.col("rule_title") == F.col("of_")), "left")
    return marked.select(*rows.columns, F.col("id_").isNotNull().alias("fresh"))


def sliced(rows: DataFrame) -> DataFrame:
    """Rows of streams with slice, a stretch of time that is SLICE times as long as the stream's longest span, and home.

    A row that a window of the next slice can see is there, too, and not at
    home: so a key with a third of all hits is as many tasks as it has slices.
    """
    length = F.col("reach") * SLICE
    at = F.floor(F.col("at_us") / length)
    near = F.col("at_us") >= (at + 1) * length - F.col("reach")
    both = F.when(near, F.array(at, at + 1)).otherwise(F.array(at))
    out = rows.withColumn("at_", at).withColumn("slice", F.explode(both))
    return out.withColumn("home", F.col("slice") == F.col("at_")).drop("at_")


def tasks(hits: DataFrame, rules: Rules, most: int = TASK_ROWS) -> int:
    """How many tasks windows over all rows of the rules take. What is shuffled is hits, which then become as many rows as there are rules of their title, so sizes of shuffled data don't tell; hits are counted by title."""
    met = Counter(t for c in rules.correlations for t in set(c.titles))
    counts = hits.where(F.col("rule_title").isin(rules.titles)).groupBy("rule_title").agg(F.count("*").alias("n")).collect()
    return max(hits.sparkSession.sparkContext.defaultParallelism, -(-sum(r.n * met[r.rule_title] for r in counts) // most))


def evaluate_all(hits: DataFrame, correlations: list[Correlation], anchors: str = "every_hit", new_hits: DataFrame | None = None, late: bool = True, final_step_only: bool = False) -> DataFrame:
    """Anchors at which correlations fire: rule (its place in the list), event_id, rule_title, source_batch, event_ts, n, and the key's names and keys.

    As correlation.evaluate() for each of them. late, with new_hits: stored
    hits whose windows hold a new one are anchors as well.
    """
    rules = Rules(correlations)
    columns = ["rule", "event_id", "rule_title", "source_batch", "event_ts", "n", "names", "keys"]
    rows = None
    if correlations:
        rows = _streams(hits, rules).withColumn("fresh", F.lit(True)) if new_hits is None else _touched(hits, new_hits, rules)
    if rows is None:
        return hits.sparkSession.createDataFrame([], "rule int, event_id string, rule_title string, source_batch string, event_ts timestamp_ntz, n bigint, names array<string>, keys array<string>")
    own = ["g", "source_batch", "keys", "slice", "rule"]
    table = rules.rule_table(hits.sparkSession).withColumnRenamed("g", "g_")
    rows = sliced(rows)
    # The one shuffle; all windows below are within its partitions.
    rows = rows.repartition(tasks(hits, rules), "g", "source_batch", "keys", "slice").join(_small(table, len(correlations) * len(rules.titles)), (F.col("g") == F.col("g_")) & (F.col("rule_title") == F.col("title_")))
    value = F.when(F.col("counts") == "hits", "").when(F.col("counts") == "values", F.try_element_at("group_values", F.col("field"))).otherwise(F.col("rule_title"))
    # Windows sort what is left here, so it is little.
    rows = rows.select(*own, "event_id", "rule_title", "event_ts", "at_us", "fresh", "home", "span", (F.col("counts") == "hits").alias("each_"), "places", "steps", value.alias("value_"))
    in_order_ = Window.partitionBy(*own).orderBy("at_us", "event_id", "rule_title")
    began = F.lit(None).cast("bigint")
    for i in range(rules.steps):
        since = F.col("at_us")
        if i:
            # A hit continues what was there before it, so that none serves two steps.
            rows = rows.withColumn("prior_", F.max(f"step{i - 1}").over(in_order_.rowsBetween(Window.unboundedPreceding, -1)))
            since = F.col("prior_")
        rows = rows.withColumn(f"step{i}", F.max(F.when(F.array_contains("places", i), since)).over(in_order_.rowsBetween(Window.unboundedPreceding, 0)))
        began = F.when(F.col("steps") == i + 1, F.col(f"step{i}")).otherwise(began)
    rows = rows.withColumn("began_", began).drop("places", "steps", *[f"step{i}" for i in range(rules.steps)], "prior_")
    anchor = F.col("fresh")
    if new_hits is not None and late:
        newest = F.max(F.when(F.col("fresh"), F.col("at_us"))).over(Window.partitionBy(*own).orderBy("at_us").rangeBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("newest_", newest)
        anchor = F.coalesce(F.col("at_us") - F.col("newest_") <= F.col("span"), F.lit(False))
    if anchors == "latest_in_batch":
        key = ["g", "source_batch", "keys", "rule"]
        latest = rows.where("fresh and home").groupBy(*key).agg(F.max("at_us").alias("latest_")).select(*[F.col(k).alias(f"{k}_of") for k in key], "latest_")
        rows = rows.join(latest, J.all_of([F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in key]), "left").drop(*[f"{k}_of" for k in key])
        anchor = F.coalesce(F.col("fresh") & (F.col("at_us") == F.col("latest_")), F.lit(False))
    rows = rows.withColumn("anchor_", anchor & F.col("home")).drop("fresh", "home", "newest_", "latest_")
    after = F.lead("at_us").over(Window.partitionBy(*own, "value_").orderBy("at_us", "event_id", "rule_title"))
    over = F.col("at_us") + F.col("span") + 1
    rows = rows.withColumn("until_", F.when(F.col("each_"), over).otherwise(F.least(over, after)))
    there = F.col("value_").isNotNull()
    comes = F.struct(F.lit(True).alias("hit_"), F.col("at_us").alias("when_"), F.when(there, 1).otherwise(0).alias("step_"))
    goes = F.struct(F.lit(False).alias("hit_"), F.col("until_").alias("when_"), F.lit(-1).alias("step_"))
    both = rows.withColumn("x_", F.explode(F.when(there, F.array(comes, goes)).otherwise(F.array(comes)))).select(*own, "event_id", "rule_title", "event_ts", "at_us", "span", "began_", "anchor_", "x_.*")
    n = F.sum("step_").over(Window.partitionBy(*own).orderBy("when_").rangeBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("n", n.cast("bigint")).where(F.col("hit_") & F.col("anchor_"))
    rows = rows.join(_small(rules.test_table(hits.sparkSession), len(correlations)), F.col("rule") == F.col("rule_"))
    by = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__, "eq": Column.__eq__, "neq": Column.__ne__}
    met = F.col("known") & J.all_of([F.col(op).isNull() | by[op](F.col("n"), F.col(op)) for op in COUNT_OPS])
    fires = F.when(F.col("counted"), met).otherwise(F.col("n") >= F.col("least"))
    ordered = F.coalesce(F.col("began_") >= F.col("at_us") - F.col("span"), F.lit(False))
    if final_step_only:
        ordered = ordered & (F.col("rule_title") == F.col("final"))
    return rows.where(fires & (~F.col("ordered") | ordered)).select(*columns)


def _key(rules: Rules) -> Column:
    """An alert's identity: of the rule's id and the key's parts."""
    return F.substring(F.sha2(F.concat_ws(":", rules.head(F.col("rule"))["id"], "keys"), 256), 1, 16)


def own_hits(fired: DataFrame, correlations: list[Correlation]) -> DataFrame:
    """The hits that fired correlations are themselves, one per key and anchor time, for rules above them."""
    rules = Rules(correlations)
    title = rules.head(F.col("rule"))["title"]
    event_id = F.concat(F.lit("corr:"), title, F.lit(":"), _key(rules), F.lit(":"), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    hits = fired.select(event_id.alias("event_id"), title.alias("rule_title"), "source_batch", "event_ts", F.map_from_arrays("names", "keys").alias("group_values"))
    return hits.dropDuplicates(["event_id", "source_batch"])


def levels(correlations: list[Correlation]) -> list[list[Correlation]]:
    """Correlations by how many passes must come before theirs; informational ones take no part. What is on a cycle comes in the order given."""
    out: list[list[Correlation]] = []
    at: dict[str, int] = {}
    for c in in_order([c for c in correlations if c.level != "informational"]):
        at[c.title] = 1 + max((at[t] for t in c.titles if t in at), default=-1)
        out += [[]] * (at[c.title] + 1 - len(out))
        out[at[c.title]] = [*out[at[c.title]], c]
    return out


def _not_stored(own: DataFrame, hits: DataFrame, correlations: list[Correlation]) -> DataFrame:
    """Correlations' hits less those that are stored: an anchor that a late hit makes fire again is counted once by the rules above."""
    stored = hits.where(F.col("rule_title").isin([c.title for c in correlations])).select(F.col("event_id").alias("id_"), F.col("source_batch").alias("batch_"))
    return own.join(stored, (F.col("event_id") == F.col("id_")) & F.col("source_batch").eqNullSafe(F.col("batch_")), "left_anti")


def correlate_all(hits: DataFrame, correlations: list[Correlation], anchors: str = "every_hit", new_hits: DataFrame | None = None, late: bool = True, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[list[tuple[list[Correlation], DataFrame]], DataFrame]:
    """Per level, its correlations and their fired anchors; and the hits that they add. keep writes a table that several plans read, by its name."""
    out, added, pool, fresh = [], hits.where("false"), hits, new_hits
    for i, level in enumerate(levels(correlations)):
        fired = keep(evaluate_all(pool, level, anchors, fresh, late), f"fired{i}")
        out.append((level, fired))
        own = own_hits(fired, level)
        added = added.unionByName(own)
        pool = pool.unionByName(own if new_hits is None else _not_stored(own, hits, level))
        fresh = None if fresh is None else fresh.select(*own.columns).unionByName(own)
    return out, added


def alerts_of(fired: DataFrame, correlations: list[Correlation], hits: DataFrame, events: DataFrame, stored: DataFrame | None = None, samples: int = 10) -> DataFrame:
    """An alert for each rule, source batch and key, of its latest anchor, with entities and samples of the earliest events in that window.

    fired is read twice. stored: earlier hits of the correlations; an
    anchor that is older than one there gives no alert, as that of the later one stands.
    """
    rules = Rules(correlations)
    same = ["rule", "source_batch", "keys"]
    # An alert is a key's, however many anchors it has: so are what is joined by broadcast, and the texts that are looked up.
    n, low, high = fired.groupBy(*same).agg(F.min("event_ts").alias("low"), F.max("event_ts").alias("high")).agg(F.count("*"), F.min("low"), F.max("high")).first()
    w = Window.partitionBy(*same).orderBy(F.desc("event_ts"), F.desc("n"), "event_id")
    last = fired.withColumn("r_", F.row_number().over(w)).where("r_ = 1").select("rule", "source_batch", "names", "keys", F.col("event_ts").alias("end_"), "n")
    if stored is not None and n:
        seen = stored.where(F.col("rule_title").isin([c.title for c in correlations]) & (F.col("event_ts") > F.lit(low).cast("timestamp_ntz")))
        keys = F.lit(None).cast("array<string>")
        for names in rules.streams:
            mine = F.col("rule_title").isin([c.title for c in correlations if c.group_by == names])
            keys = F.when(mine, F.array(*[F.try_element_at("group_values", F.lit(f)) for f in names])).otherwise(keys)
        seen = seen.select(F.col("rule_title").alias("of_"), F.col("source_batch").alias("batch_"), keys.alias("keys_"), "event_ts")
        later = seen.groupBy("of_", "batch_", "keys_").agg(F.max("event_ts").alias("newest_"))
        match = (rules.head(F.col("rule"))["title"] == F.col("of_")) & F.col("source_batch").eqNullSafe(F.col("batch_")) & (F.col("keys") == F.col("keys_")) & (F.col("end_") < F.col("newest_"))
        last = last.join(later, match, "left_anti")
    table = rules.rule_table(fired.sparkSession).select(F.col("g").alias("g_"), "title_", "rule", "span")
    some = hits
    if n:
        some = hits.where(F.col("event_ts").between(F.lit(low - timedelta(microseconds=rules.reach)).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
    base = _streams(some, rules).join(_small(table, len(correlations) * len(rules.titles)), (F.col("g") == F.col("g_")) & (F.col("rule_title") == F.col("title_")))
    base = base.select(F.col("rule").alias("rule_"), F.col("source_batch").alias("batch_"), F.col("keys").alias("keys_"), "event_id", "event_ts", "span")
    near = (F.col("rule") == F.col("rule_")) & F.col("source_batch").eqNullSafe(F.col("batch_")) & (F.col("keys") == F.col("keys_")) & F.col("event_ts").between(F.col("end_") - F.make_dt_interval(secs=F.col("span") / 1_000_000), F.col("end_"))
    group = ["rule", "source_batch", "names", "keys", "n", "end_"]
    inside = base.join(_small(last, n), near).select(*group, "event_id", "event_ts").dropDuplicates(["rule", "source_batch", "keys", "event_id"])
    few = inside.withColumn("r_", F.row_number().over(Window.partitionBy(*same).orderBy("event_ts", "event_id"))).where(F.col("r_") <= samples)
    wanted = events.select("event_id", "host", "user_name", "src_ip", "dst_ip", "process", "raw", F.col("event_ts").alias("time_"))
    if n:
        wanted = wanted.where(F.col("time_").between(F.lit(low - timedelta(microseconds=rules.reach)).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
    wanted = wanted.drop("time_").join(_small(few.select("event_id").distinct(), n * samples), "event_id", "left_semi")
    shown = few.join(wanted, "event_id", "left").groupBy(*group).agg(entity_sets().alias("entities"), F.min_by("host", "r_").alias("host_"), F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("r_", "raw")))).alias("s"))
    head = rules.head(F.col("rule"))
    return shown.select(
        _key(rules).alias("dedup_key"), F.lit("correlation").alias("engine"), "source_batch", F.coalesce("host_", F.concat_ws("-", "keys")).alias("host"), head["id"].alias("rule_id"), head["title"].alias("rule_title"),
        head["level"].alias("rule_level"), F.col("n").alias("event_count"), "entities", F.col("s.raw").alias("sample_events"), F.col("end_").alias("event_ts"),
    )
