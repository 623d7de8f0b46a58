"""Alerts from matches: groups by host and source, entities, samples, and the two ways to store them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sigma import LEVELS
from .events import SEVERITY
from .kb import enrich
from .paging import Key, seek

ENTITIES = {"users": "user_name", "hosts": "host", "src_ips": "src_ip", "dst_ips": "dst_ip", "processes": "process"}
SAMPLE = 10


def severity(level: Column) -> Column:
    """A known level, or informational."""
    return F.when(level.isin(list(LEVELS)), level).otherwise("informational")


def techniques(tags: Column) -> Column:
    """The tags of a rule that name ATT&CK techniques (attack.t...), as they are and in their order."""
    return F.filter(tags, lambda t: t.startswith("attack.t"))


def dedup_key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def entity_sets() -> Column:
    """The struct of sorted distinct values of each kind; to be used in an aggregate."""
    return F.struct(*[F.array_sort(F.collect_set(c)).alias(k) for k, c in ENTITIES.items()])


def group_matches(matches: DataFrame, scope_by_source: bool = False, with_samples: bool = True, order: tuple[str, ...] = ("event_time", "event_id")) -> DataFrame:
    """One alert per rule, host and source batch.

    matches: one row per event and rule (rule_id, rule_title, rule_level,
    tags), with host, source_batch and the promoted columns. Informational
    rules give none. The dedup key is of the rule, the host and the first user
    by name, or the host again if there is no user; scope_by_source puts the
    source in it, too.
    """
    keys = ["rule_id", "rule_title", "host", "source_batch"]
    some = matches.withColumn("rule_level", severity(F.col("rule_level"))).where("rule_level != 'informational'")
    out = some.groupBy(*keys).agg(F.min("rule_level").alias("rule_level"), F.min("tags").alias("tags"), F.count("*").alias("event_count"), entity_sets().alias("entities"))
    main = F.coalesce(F.get("entities.users", F.lit(0)), F.col("host"))
    parts = [F.col("rule_id"), F.col("host"), main] + ([F.col("source_batch")] if scope_by_source else [])
    out = out.withColumn("dedup_key", dedup_key(*parts)).withColumn("mitre_techniques", techniques(F.col("tags"))).drop("tags")
    if with_samples:
        out = with_sample_events(out, some, keys, list(order))
    return out.withColumn("engine", F.lit("rules")).withColumn("status", F.lit("new"))


def with_sample_events(groups: DataFrame, matches: DataFrame, keys: list[str], order: list[str], limit: int = SAMPLE) -> DataFrame:
    """groups (with event_count) and their sample_events: raw texts of all rows in order, or of the first and last few of more than limit.

    Both ends are ranks below a small number, which each task applies before
    it sends rows: texts that no group shows are not shuffled.
    """
    half = limit // 2
    rows = matches.select(*keys, *order, "raw")
    by = Window.partitionBy(*keys)

    def end(name: str, sort: list[Column], most: int) -> DataFrame:
        few = rows.withColumn("at", F.row_number().over(by.orderBy(*sort))).where(F.col("at") <= most)
        return few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias(name))

    first = end("first_", [F.col(c).asc() for c in order], limit)
    last = end("last_", [F.col(c).desc() for c in order], limit - half)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    both = groups.alias("g").join(first.alias("f"), same("g", "f"), "left").join(last.alias("l"), same("g", "l"), "left")
    shown = F.when(F.col("event_count") <= limit, F.col("first_.raw")).otherwise(F.concat(F.slice(F.col("first_.raw"), 1, half), F.reverse(F.col("last_.raw"))))
    return both.select("g.*", shown.alias("sample_events"))


def one_per_key(new: DataFrame, add: bool | Column = True) -> DataFrame:
    """New alerts, those with one key as one, with adds_: whether its count adds to a stored one or takes its place."""
    order = Window.partitionBy("dedup_key").orderBy("source_batch", "host", "rule_title")
    last = Window.partitionBy("dedup_key").orderBy(F.desc("source_batch"), F.desc("host"), F.desc("rule_title"))
    adds = F.lit(add) if isinstance(add, bool) else add
    n = F.when(adds, F.sum("event_count").over(Window.partitionBy("dedup_key"))).otherwise(F.first("event_count").over(last))
    latest = F.first("sample_events").over(last)
    return new.withColumn("adds_", adds).withColumn("event_count", n).withColumn("sample_events", latest).withColumn("k_", F.row_number().over(order)).where("k_ = 1").drop("k_")


def upsert(stored: DataFrame, new: DataFrame, add: bool | Column = True) -> DataFrame:
    """stored with new alerts by dedup_key.

    An alert that is stored keeps all but event_count (the sum, or with add off
    the new count) and sample_events (the new ones). Several new alerts with
    one key count together; the first by source_batch, host and title gives the rest.
    add may be a column of new, so that one merge takes alerts of both kinds.
    """
    one = one_per_key(new, add)
    columns = stored.columns
    both = stored.alias("s").join(one.select(*columns, "adds_").alias("n"), "dedup_key", "full_outer")
    had = F.col("s.event_count").isNotNull()
    made = []
    for c in columns:
        s, x = F.col(f"s.{c}"), F.col(f"n.{c}")
        if c == "dedup_key":
            made.append(F.col("dedup_key"))
        elif c == "event_count":
            counted = F.when(F.col("n.adds_"), s + F.coalesce(x, F.lit(0))).otherwise(F.coalesce(x, s))
            made.append(F.when(had, counted).otherwise(x).alias(c))
        elif c == "sample_events":
            made.append(F.coalesce(x, s).alias(c))
        else:
            made.append(F.when(had, s).otherwise(x).alias(c))
    return both.select(*made)


def fold_changes(changes: DataFrame) -> DataFrame:
    """One change per dedup_key from several: what upsert, called for one after the other, would leave.

    changes: the columns of alerts and seq_ (their order), adds_ (as of
    one_per_key) and set_status_. A change without event_count only sets the
    status. The first one with a count gives all but the count, the samples
    (the last ones) and the status (the last one set, or the first one's own).
    Any run of neighbours may be folded before the rest: the result is the
    same. A key has at most one row a part, so no group is large.
    """
    own = [c for c in changes.columns if c not in ("dedup_key", "seq_", "adds_", "set_status_", "event_count", "sample_events")]
    counts = F.array_sort(F.collect_list(F.when(F.col("event_count").isNotNull(), F.struct("seq_", "adds_", "event_count"))))
    total = F.aggregate("counts_", F.lit(None).cast("bigint"), lambda n, c: F.when(c["adds_"], F.coalesce(n, F.lit(0)) + c["event_count"]).otherwise(c["event_count"]))
    found = changes.groupBy("dedup_key").agg(
        F.min_by(F.struct(*own), F.when(F.col("event_count").isNotNull(), F.col("seq_"))).alias("own_"), counts.alias("counts_"), F.max("seq_").alias("seq_"),
        F.max_by("sample_events", F.when(F.col("sample_events").isNotNull(), F.col("seq_"))).alias("sample_events"),
        F.max_by("set_status_", F.when(F.col("set_status_").isNotNull(), F.col("seq_"))).alias("set_status_"),
    )
    made = {"event_count": total, "adds_": F.forall("counts_", lambda c: c["adds_"])} | {c: F.col(f"own_.{c}") for c in own}
    return found.select(*[made[c].alias(c) if c in made else F.col(c) for c in changes.columns])


def set_status(alerts: DataFrame, alert_id: str, status: str) -> DataFrame:
    return alerts.withColumn("status", F.when(F.col("alert_id") == alert_id, F.lit(status)).otherwise(F.col("status")))


def severity_rank(level: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def list_alerts(alerts: DataFrame, source_batch: str | None = None, status: str | None = None, rule_level: str | None = None, time_from: str | None = None, time_to: str | None = None, sort_by: str | None = None, descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of alerts without their samples; dedup_key breaks ties."""
    some = chosen(alerts, source_batch, status, rule_level, time_from, time_to)
    page = some.orderBy(*[k.desc() if down else k.asc() for k, down in alert_keys(sort_by, descending)]).offset(offset).limit(limit)
    return page.drop("sample_events")


def seek_alerts(alerts: DataFrame, after: str | None = None, sort_by: str | None = None, descending: bool = True, limit: int = 100, **filters) -> DataFrame:
    """The page of list_alerts behind the row whose cursor is after, the first one without; rows have a cursor."""
    return seek(chosen(alerts, **filters), alert_keys(sort_by, descending), after, limit).drop("sample_events")


def chosen(alerts: DataFrame, source_batch: str | None = None, status: str | None = None, rule_level: str | None = None, time_from: str | None = None, time_to: str | None = None) -> DataFrame:
    """Alerts by all filters that are given; both ends of the times are included."""
    for c, v in (("source_batch", source_batch), ("status", status), ("rule_level", rule_level)):
        if v is not None:
            alerts = alerts.where(F.col(c) == v)
    if time_from is not None:
        alerts = alerts.where(F.col("created_at") >= time_from)
    if time_to is not None:
        alerts = alerts.where(F.col("created_at") <= time_to)
    return alerts


def alert_keys(sort_by: str | None = None, descending: bool = True) -> list[Key]:
    """Sort keys, each with its direction; an unknown name sorts by creation, latest first."""
    key = severity_rank(F.col("rule_level")) if sort_by == "rule" else F.col(sort_by if sort_by in ("host", "event_count", "status") else "created_at")
    down = descending or sort_by not in ("rule", "host", "event_count", "status", "created_at")
    return [(key, down), (F.col("dedup_key"), False)]


def alert_detail(alerts: DataFrame, alert_id: str, kb: dict[str, DataFrame] | None) -> DataFrame:
    """One alert with its techniques looked up: the array techniques of id, name, tactics and whether it is known. Without a knowledge base the array is null."""
    one = get_alert(alerts, alert_id)
    if kb is None:
        return one.withColumn("techniques", F.lit(None).cast("array<struct<technique_id:string,name:string,tactics:array<string>,matched:boolean>>"))
    found = enrich(one, kb, "alert_id", "mitre_techniques")
    rows = found.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("pos", "technique_id", "name", "tactics", "matched"))).alias("t"))
    fields = F.transform("t", lambda x: F.struct(x["technique_id"].alias("technique_id"), x["name"].alias("name"), x["tactics"].alias("tactics"), x["matched"].alias("matched")))
    return one.join(rows.select("alert_id", fields.alias("techniques")), "alert_id", "left")


def get_alert(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id).limit(1)
