"""Correlation rules over a ledger of rule hits, as windows in event time.

Every hit is an anchor: the hits of the same source batch and key in the
closed window that ends there decide, so one pass over sorted hits is exact
for all keys at once. A hit of a correlation that fired is a row of the same
ledger for the rules above it.

For a batch of new hits, only the keys that these touch are read, and only
from the first of them less the rule's span on: the cost follows the batch and
its windows, not the ledger.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..plans.catalog import Correlation, in_order
from .alerts import dedup_key, entity_sets

#: Keys, and events, up to this number are joined by broadcast.
BROADCAST_KEYS = 100_000
LEDGER = "event_id string, rule_title string, source_batch string, event_ts timestamp_ntz, group_values map<string,string>"


def hit_spec(correlations: list[Correlation]) -> dict[str, list[str]]:
    """Per title of a base rule, the fields that correlations need of its hits."""
    out: dict[str, dict[str, None]] = {}
    for c in correlations:
        for title, kind in c.base_rules:
            if kind == "rule":
                need = out.setdefault(title, {})
                for f in (*c.group_by, *([c.distinct_field] if c.distinct_field else [])):
                    need[f] = None
    return {k: list(v) for k, v in out.items()}


def ledger(matched: DataFrame, spec: dict[str, list[str]]) -> DataFrame:
    """Hits of the titles in spec with the fields they need, as text. Each event and title once; events without a time have a null one."""
    raw = F.col("raw")
    titles = F.filter(F.array_distinct("matched_rules"), lambda t: t.isin(list(spec)) if spec else F.lit(False))
    some = matched.select("event_id", "source_batch", "event_ts", "raw", titles.alias("titles_")).where(F.size("titles_") > 0)
    fields = sorted({f for fs in spec.values() for f in fs})
    parsed, looked_up = J.with_texts(some, fields)
    if not fields:
        every = F.create_map().cast("map<string,string>")
    else:
        every = F.create_map(*[x for f in fields for x in (F.lit(f), J.text(raw, f, looked_up[f]))])
    hits = parsed.select("event_id", "source_batch", "event_ts", every.alias("every_"), F.explode("titles_").alias("rule_title"))
    wanted = F.create_map(*[x for t, fs in spec.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fs]).cast("array<string>"))]) if spec else F.create_map().cast("map<string,array<string>>")
    values = F.map_filter("every_", lambda k, v: v.isNotNull() & F.array_contains(F.try_element_at(wanted, F.col("rule_title")), k))
    return hits.select("event_id", "rule_title", "source_batch", "event_ts", values.alias("group_values")).dropDuplicates(["event_id", "rule_title"])


def append_hits(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New hits that are not stored yet: an insert that ignores repeats."""
    return new.dropDuplicates(["event_id", "rule_title"]).join(stored.select("event_id", "rule_title"), ["event_id", "rule_title"], "left_anti")


def condition_met(condition: dict, n: Column) -> Column:
    """All comparisons of a condition, as numbers; false if it has none. A threshold that is no number is passed over."""
    by = {"gte": n.__ge__, "gt": n.__gt__, "lte": n.__le__, "lt": n.__lt__, "eq": n.__eq__, "neq": n.__ne__}
    parts = []
    for k, v in condition.items():
        try:
            parts += [by[k](F.lit(float(v)))] if k in by else []
        except (TypeError, ValueError):
            continue
    return J.all_of(parts) if parts else F.lit(False)


def _window(keys: list[str], span: int):
    """Rows of the same key within span seconds before, both ends included; times are whole microseconds."""
    return Window.partitionBy(*keys).orderBy("at_us").rangeBetween(-span * 1_000_000, 0)


def _with_steps(rows: DataFrame, keys: list[str], titles: tuple[str, ...]) -> DataFrame:
    """Adds step0, step1, ...: the latest time at which a run of the steps so far can have begun. Linear in the hits, whatever the span."""
    order = Window.partitionBy(*keys).orderBy("at_us", "event_id", "rule_title")
    for i, title in enumerate(titles):
        if i == 0:
            since = F.col("at_us")
        elif title in titles[:i]:
            # A title that is repeated may not serve two steps by one hit.
            rows = rows.withColumn("prior_", F.max(f"step{i - 1}").over(order.rowsBetween(Window.unboundedPreceding, -1)))
            since = F.col("prior_")
        else:
            since = F.col(f"step{i - 1}")
        rows = rows.withColumn(f"step{i}", F.max(F.when(F.col("rule_title") == title, since)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows


def _keyed(hits: DataFrame, c: Correlation) -> DataFrame:
    """The rule's hits with its keys and time; those without all of them are left out."""
    rows = hits.where(F.col("rule_title").isin(list(c.titles))).select(
        "event_id", "rule_title", "source_batch", "event_ts", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("at_us"), "group_values",
        *[F.col("group_values")[g].alias(f"k{i}") for i, g in enumerate(c.group_by)],
    )
    for k in [*(f"k{i}" for i in range(len(c.group_by))), "at_us"]:
        rows = rows.where(F.col(k).isNotNull())
    return rows


def _touched(hits: DataFrame, new: DataFrame, c: Correlation) -> DataFrame | None:
    """The keyed hits that windows of new hits can see; None if there are no new ones.

    The span of all of them is a literal, which reaches the file scan; each
    key's own span follows, by broadcast up to a checked number of keys.
    """
    keys = ["source_batch", *(f"k{i}" for i in range(len(c.group_by)))]
    per_key = _keyed(new, c).groupBy(*keys).agg((F.min("at_us") - c.timespan * 1_000_000).alias("low"), F.max("at_us").alias("high"))
    n, low, high = per_key.agg(F.count("*"), F.min("low"), F.max("high")).first()
    if not n:
        return None
    moment = lambda us: F.lit(datetime(1970, 1, 1) + timedelta(microseconds=us)).cast("timestamp_ntz")
    rows = _keyed(hits.where(F.col("event_ts").between(moment(low), moment(high))), c)
    seen = per_key.select(*[F.col(k).alias(f"{k}_") for k in keys], "low", "high")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return rows.join(F.broadcast(seen) if n <= BROADCAST_KEYS else seen, [*same, F.col("at_us").between(F.col("low"), F.col("high"))]).select(rows.columns)


def _distinct(rows: DataFrame, part: list[str], value: Column, span: int) -> DataFrame:
    """rows with n, the number of values other than null in the span before each, in time linear in the rows.

    A hit is its value's latest from its time until the next hit of the value
    or the end of the span: it adds one there and takes it back afterwards, so
    n is a running sum over both.
    """
    rows = rows.withColumn("value_", value)
    after = F.lead("at_us").over(Window.partitionBy(*part, "value_").orderBy("at_us", "event_id", "rule_title"))
    rows = rows.withColumn("until_", F.least(F.col("at_us") + span * 1_000_000 + 1, after))
    shown = F.array(F.struct(F.lit(True).alias("hit_"), F.col("at_us").alias("when_"), F.when(F.col("value_").isNotNull(), 1).otherwise(0).alias("step_")), F.struct(F.lit(False).alias("hit_"), F.col("until_").alias("when_"), F.lit(-1).alias("step_")))
    shown = F.filter(shown, lambda x: x["hit_"] | F.col("value_").isNotNull())
    both = rows.withColumn("x_", F.explode(shown)).select(*rows.columns, "x_.*")
    running = F.sum("step_").over(Window.partitionBy(*part).orderBy("when_").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("n", running).where("hit_").drop("value_", "until_", "hit_", "when_", "step_")


def evaluate(hits: DataFrame, c: Correlation, anchors: str = "every_hit", new_hits: DataFrame | None = None, final_step_only: bool = False) -> DataFrame:
    """Anchors at which a correlation fires: event_id, source_batch, event_ts, rule_title of the anchor hit, n, and the key's fields as k0, k1, ...

    anchors: every_hit, or latest_in_batch (of each key the latest new hit
    only). new_hits: rows of the ledger that are new; only these are anchors.
    Hits with a missing key field or time take no part.
    """
    keys = [f"k{i}" for i in range(len(c.group_by))]
    part = ["source_batch", *keys]
    rows = _keyed(hits, c) if new_hits is None else _touched(hits, new_hits, c)
    if rows is None:
        rows = _keyed(hits.where("false"), c)
    w = _window(part, c.timespan)
    if c.kind == "event_count":
        rows = rows.withColumn("n", F.count("*").over(w))
        fires = condition_met(c.condition, F.col("n"))
    elif c.kind == "value_count":
        rows = _distinct(rows, part, F.col("group_values")[c.distinct_field], c.timespan)
        fires = condition_met(c.condition, F.col("n"))
    else:
        # As many counts as titles: distinct titles without gathering them.
        seen = [F.when(F.max(F.when(F.col("rule_title") == t, 1)).over(w) == 1, 1).otherwise(0) for t in dict.fromkeys(c.titles)]
        total = seen[0]
        for s in seen[1:]:
            total = total + s
        rows = rows.withColumn("n", total.cast("long"))
        counted = any(k != "field" for k in c.condition)
        fires = condition_met(c.condition, F.col("n")) if counted else F.col("n") >= len(set(c.titles))
        if c.kind == "temporal_ordered":
            rows = _with_steps(rows, part, c.titles)
            last = F.col(f"step{len(c.titles) - 1}")
            fires = fires & last.isNotNull() & (last >= F.col("at_us") - c.timespan * 1_000_000)
            if final_step_only:
                fires = fires & (F.col("rule_title") == c.titles[-1])
    fresh = F.lit(True)
    if new_hits is not None:
        ids = new_hits.select(F.col("event_id").alias("new_id_"), F.col("rule_title").alias("new_title_")).distinct()
        rows = rows.join(ids, (F.col("event_id") == F.col("new_id_")) & (F.col("rule_title") == F.col("new_title_")), "left")
        fresh = F.col("new_id_").isNotNull()
    if anchors == "latest_in_batch":
        latest = F.max(F.when(fresh, F.col("at_us"))).over(Window.partitionBy(*part))
        rows = rows.withColumn("latest_", latest)
        fires = fires & (F.col("at_us") == F.col("latest_"))
    return rows.where(fires & fresh).select("event_id", "rule_title", "source_batch", "event_ts", "n", *keys)


def as_hits(fired: DataFrame, c: Correlation) -> DataFrame:
    """A correlation's own hits, one per key and anchor time. Their ids are of the rule, the key and the time, so a rerun adds none."""
    keys = [F.col(f"k{i}") for i in range(len(c.group_by))]
    key = dedup_key(F.lit(c.id), *keys)
    values = F.create_map(*[x for g, k in zip(c.group_by, keys, strict=True) for x in (F.lit(g), k)])
    hits = fired.select(F.concat(F.lit(f"corr:{c.title}:"), key, F.lit(":"), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("event_id"), F.lit(c.title).alias("rule_title"), "source_batch", "event_ts", values.alias("group_values"))
    return hits.dropDuplicates(["event_id", "source_batch"])


def correlate(hits: DataFrame, correlations: list[Correlation], anchors: str = "every_hit", new_hits: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Fired anchors by correlation title, and the hits that correlations add. Children come first and feed their parents. Informational ones take no part at all."""
    out: dict[str, DataFrame] = {}
    added: DataFrame | None = None
    pool, fresh = hits, new_hits
    for c in in_order([c for c in correlations if c.level != "informational"]):
        out[c.title] = evaluate(pool, c, anchors, fresh)
        own = as_hits(out[c.title], c)
        added = own if added is None else added.unionByName(own)
        if any(c.title in p.titles for p in correlations):
            pool = pool.unionByName(own)
            fresh = None if fresh is None else fresh.select(*own.columns).unionByName(own)
    return out, added if added is not None else hits.where("false")


def fired_alerts(fired: DataFrame, c: Correlation, hits: DataFrame, events: DataFrame, samples: int = 10) -> DataFrame:
    """An alert for each key, of its latest anchor, with entities and samples of the earliest events in that window."""
    keys = [f"k{i}" for i in range(len(c.group_by))]
    w = Window.partitionBy("source_batch", *keys).orderBy(F.desc("event_ts"), F.desc("n"), "event_id")
    last = fired.withColumn("r_", F.row_number().over(w)).where("r_ = 1").select(F.col("source_batch").alias("batch_"), *[F.col(k).alias(f"{k}_") for k in keys], F.col("event_ts").alias("end_"), "n")
    base = hits.where(F.col("rule_title").isin(list(c.titles))).select("event_id", "source_batch", "event_ts", *[F.col("group_values")[g].alias(k) for g, k in zip(c.group_by, keys, strict=True)])
    same = [F.col(k) == F.col(f"{k}_") for k in keys] + [F.col("source_batch") == F.col("batch_"), F.col("event_ts").between(F.col("end_") - F.make_dt_interval(secs=F.lit(c.timespan)), F.col("end_"))]
    inside = base.join(last, J.all_of(same)).select("batch_", *[f"{k}_" for k in keys], "n", "end_", "event_id", "event_ts").dropDuplicates(["batch_", *[f"{k}_" for k in keys], "event_id"])
    first = Window.partitionBy("batch_", *[f"{k}_" for k in keys]).orderBy("event_ts", "event_id")
    few = inside.withColumn("r_", F.row_number().over(first)).where(F.col("r_") <= samples)
    # The few events are looked up within their own time, and by broadcast if they are not many.
    n, low, high = few.agg(F.count("*"), F.min("event_ts"), F.max("event_ts")).first()
    wanted = events.select("event_id", "host", "user_name", "src_ip", "dst_ip", "process", "raw", F.col("event_ts").alias("time_"))
    wanted = wanted.where(F.col("time_").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))).drop("time_")
    ids = few.select("event_id").distinct()
    wanted = wanted.join(F.broadcast(ids) if n <= BROADCAST_KEYS else ids, "event_id", "left_semi")
    shown = few.join(wanted, "event_id", "left")
    group = shown.groupBy("batch_", *[f"{k}_" for k in keys], "n", "end_").agg(entity_sets().alias("entities"), F.min_by("host", "r_").alias("host_"), F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("r_", "raw")))).alias("s"))
    said = [F.col(f"{k}_") for k in keys]
    return group.select(
        dedup_key(F.lit(c.id), *said).alias("dedup_key"), F.lit("correlation").alias("engine"), F.col("batch_").alias("source_batch"), F.coalesce("host_", F.concat_ws("-", *said)).alias("host"),
        F.lit(c.id).alias("rule_id"), F.lit(c.title).alias("rule_title"), F.lit(c.level).alias("rule_level"), F.col("n").alias("event_count"), "entities", F.col("s.raw").alias("sample_events"), F.col("end_").alias("event_ts"),
    )


def window_counts(hits: DataFrame, titles: list[str], group_by: list[str], time_from: str, time_to: str, mode: str = "events", distinct_field: str | None = None) -> DataFrame:
    """Per key the count in a fixed window: events, distinct_values of a field, or distinct_rules. Keys with a missing part are left out."""
    keys = [f"k{i}" for i in range(len(group_by))]
    rows = hits.where(F.col("rule_title").isin(titles) & F.col("event_ts").between(F.lit(time_from).cast("timestamp_ntz"), F.lit(time_to).cast("timestamp_ntz")))
    rows = rows.select("source_batch", "rule_title", "group_values", *[F.col("group_values")[g].alias(k) for g, k in zip(group_by, keys, strict=True)]).na.drop(subset=keys)
    n = {"events": F.count("*"), "distinct_values": F.count_distinct(F.col("group_values")[distinct_field or ""]), "distinct_rules": F.count_distinct("rule_title")}[mode]
    return rows.groupBy("source_batch", *keys).agg(n.alias("n"))


def key_window(hits: DataFrame, events: DataFrame, titles: list[str], key: dict[str, str], source_batch: str, time_from: str, time_to: str, mode: str = "events", distinct_field: str | None = None, samples: int = 10) -> DataFrame:
    """One row for one key in a fixed window: n, and sample_events, the raw texts of the earliest hits' events. No titles or an empty key: n is 0."""
    w = F.col("event_ts").between(F.lit(time_from).cast("timestamp_ntz"), F.lit(time_to).cast("timestamp_ntz"))
    rows = hits.where(F.col("rule_title").isin(titles) & (F.col("source_batch") == source_batch) & w)
    rows = rows.where(J.all_of([F.col("group_values")[k] == v for k, v in key.items()]) if key else F.lit(False))
    n = {"events": F.count("*"), "distinct_values": F.count_distinct(F.col("group_values")[distinct_field or ""]), "distinct_rules": F.count_distinct("rule_title")}[mode]
    first = rows.join(events.select("event_id", "raw"), "event_id").orderBy("event_ts", "event_id", "rule_title").limit(samples)
    shown = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("event_ts", "event_id", "rule_title", "raw"))), lambda x: x["raw"]).alias("sample_events"))
    one = F.lit(1).alias("one_")
    return rows.agg(n.alias("n")).select("n", one).join(F.broadcast(shown.select("sample_events", one)), "one_").drop("one_")
