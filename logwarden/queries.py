"""Registered queries over the test tables, one for each operator, and the SQL that gives the same rows.

The events table has no security fields, so an adapter makes them, in Spark as
JSON texts, in SQL as columns: everything below runs on whole tables. The
events are landed once for a session and folder, as ingest does it: with
their promoted columns and the rules they match, as Parquet.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import jsontext as J
from .operators import alerts as A
from .operators import correlation as C
from .operators import events as E
from .operators import joint
from .operators import kb as K
from .operators import matching as M
from .operators.paging import last_cursor
from .plans.catalog import Catalog, Correlation
from .plans.filters import compile_filter
from .plans.sigma import Rule, compile_rule
from .sources import readers as R
from .sources.sinks import append_events, append_once, exists, land, shared_dir
from .streaming import stateful
from .streaming.ingest import Pipeline
from .streaming.store import AlertTable, BatchTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The event ids that the adapter gives to event types.
CODES = {"error": 4625, "purchase": 4624, "click": 1, "view": 3, "signup": 4720}

EV = """WITH ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'batch-' || (event_id % 3) AS source_batch, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS event_time,
    'HOST-' || (user_id % 20) AS host, 'user' || user_id AS user_name, '10.0.0.' || (user_id % 50) AS ip, 'C:\\Tools\\app' || (event_id % 40) || '.EXE' AS image,
    CASE event_type WHEN 'error' THEN 4625 WHEN 'purchase' THEN 4624 WHEN 'click' THEN 1 WHEN 'view' THEN 3 ELSE 4720 END AS code,
    event_type, event_id % 40 AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, user_id % 3 = 0 AS flag, CASE WHEN user_id % 4 <> 0 THEN 'Note ' || event_type END AS note
  FROM events
), rules AS (
  SELECT *, list_filter([CASE WHEN code = 4625 THEN 'Failed logon' END, CASE WHEN code = 4624 THEN 'Logon' END, CASE WHEN code = 4720 THEN 'New account' END,
    CASE WHEN host LIKE '%-7' OR host LIKE '%-13' THEN 'Busy host' END], lambda x: x IS NOT NULL) AS titles FROM ev
), hit AS (
  SELECT *, unnest(titles) AS title FROM rules
)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def made_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, source_batch, ingested_at and raw of the events table, whose rows are spread before they become long texts."""
    t = R.spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    code = F.lit(4720)
    for kind, n in CODES.items():
        code = F.when(F.col("event_type") == kind, n).otherwise(code)
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    wide = F.decode(F.encode("event_type", "UTF-16LE"), "ISO-8859-1")
    blob = F.base64(F.encode(text("cmd app", F.col("event_id") % 40, ".exe"), "UTF-8"))
    raw = F.to_json(F.struct(
        code.alias("EventID"), text("HOST-", F.col("user_id") % 20).alias("Hostname"), text("user", F.col("user_id")).alias("TargetUserName"), text("10.0.0.", F.col("user_id") % 50).alias("IpAddress"),
        text("C:\\Tools\\app", F.col("event_id") % 40, ".EXE").alias("Image"), time.alias("SystemTime"), F.col("event_type").alias("EventType"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        (F.col("user_id") % 3 == 0).alias("Flag"), F.when(F.col("user_id") % 4 != 0, text("Note ", F.col("event_type"))).alias("Note"), F.col("user_id").alias("UserId"),
        text(F.col("user_id") % 50, "ms").alias("Latency"), wide.alias("Wide"), blob.alias("Blob"),
    ))
    return t.select(F.col("event_id").cast("string").alias("event_id"), text("batch-", F.col("event_id") % 3).alias("source_batch"), time.alias("ingested_at"), raw.alias("raw"))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event store: made once for this session and folder."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/events-{hashlib.md5(sf_dir.encode(), usedforsecurity=False).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        land(M.match(E.promote(made_events(spark, sf_dir)), pack()), path, ("event_ts",))
    return spark.read.parquet(path)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir).select("event_id", "source_batch", "ingested_at", "raw")


def pack() -> list[Rule]:
    doc = lambda i, title, level, detection, tags: {"id": i, "title": title, "level": level, "detection": detection, "tags": tags}
    docs = [
        doc("r1", "Failed logon", "medium", {"sel": {"EventID": 4625}, "condition": "sel"}, ["attack.t1110", "attack.credential_access"]),
        doc("r2", "Logon", "low", {"sel": {"EventID": 4624}, "condition": "sel"}, ["attack.t1078"]),
        doc("r3", "New account", "high", {"sel": {"EventID": 4720}, "condition": "sel"}, ["attack.t1136.001"]),
        doc("r4", "Busy host", "informational", {"sel": {"Hostname|endswith": ["-7", "-13"]}, "condition": "sel"}, []),
    ]
    return [r for d in docs for r in compile_rule(d)]


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir).drop("matched", "matched_rules", "is_matched")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir)


def hits(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("TargetUserName",)) -> DataFrame:
    return C.ledger(matched(spark, sf_dir), {t: list(fields) for t in ("Failed logon", "Logon", "New account")})


def rule(kind: str, titles: tuple[str, ...], span: int, condition: dict | None = None, group_by: tuple[str, ...] = ("TargetUserName",), **more) -> Correlation:
    return Correlation(more.pop("id", "c1"), more.pop("title", "Correlation"), kind, group_by, span, condition or {}, tuple((t, more.pop("ref", "rule")) for t in titles), level="high")


def ids(df: DataFrame) -> DataFrame:
    return df.select("event_id")


# Correlations

_KEYED = "PARTITION BY source_batch, user_name ORDER BY ts RANGE BETWEEN INTERVAL {span} SECONDS PRECEDING AND CURRENT ROW"
DAY = 86_400


def _fired(spark, sf_dir, c, fields=("TargetUserName",), **options):
    out = C.evaluate(hits(spark, sf_dir, fields), c, **options)
    return out.select("event_id", "source_batch", F.col("k0").alias("user_name"), "n")


_COUNT = EV + "SELECT event_id, source_batch, user_name, n FROM (SELECT *, count(*) OVER (" + _KEYED + ") AS n FROM hit WHERE title = 'Failed logon') WHERE n "


@query("corr_event_count", _COUNT.format(span=DAY * 3) + ">= 2")
def corr_event_count(spark, sf_dir):
    return _fired(spark, sf_dir, rule("event_count", ("Failed logon",), DAY * 3, {"gte": 2}))


@query("corr_cond_lte", _COUNT.format(span=DAY * 3) + "<= 1")
def corr_cond_lte(spark, sf_dir):
    return _fired(spark, sf_dir, rule("event_count", ("Failed logon",), DAY * 3, {"lte": 1}))


@query("corr_cond_eq", _COUNT.format(span=DAY * 3) + "= 2")
def corr_cond_eq(spark, sf_dir):
    return _fired(spark, sf_dir, rule("event_count", ("Failed logon",), DAY * 3, {"eq": 2}))


@query("corr_cond_neq", _COUNT.format(span=DAY * 3) + "<> 1")
def corr_cond_neq(spark, sf_dir):
    return _fired(spark, sf_dir, rule("event_count", ("Failed logon",), DAY * 3, {"neq": 1}))


@query("corr_value_count", EV + f"SELECT event_id, source_batch, user_name, n FROM (SELECT *, count(DISTINCT image) OVER ({_KEYED.format(span=DAY * 10)}) AS n FROM hit WHERE title = 'Failed logon') WHERE n >= 3")
def corr_value_count(spark, sf_dir):
    return _fired(spark, sf_dir, rule("value_count", ("Failed logon",), DAY * 10, {"gte": 3, "field": "Image"}), ("TargetUserName", "Image"))


@query("corr_temporal", EV + f"SELECT event_id, source_batch, user_name, n FROM (SELECT *, count(DISTINCT title) OVER ({_KEYED.format(span=DAY * 2)}) AS n FROM hit WHERE title IN ('Failed logon', 'Logon')) WHERE n >= 2")
def corr_temporal(spark, sf_dir):
    return _fired(spark, sf_dir, rule("temporal", ("Failed logon", "Logon"), DAY * 2))


_STEPS = """, s1 AS (
  SELECT *, max(CASE WHEN title = '{0}' THEN ts END) OVER (PARTITION BY source_batch, user_name ORDER BY ts, event_id, title ROWS UNBOUNDED PRECEDING) AS l1 FROM hit WHERE title IN ({titles})
), s2 AS (
  SELECT *, max(CASE WHEN title = '{1}' THEN l1 END) OVER (PARTITION BY source_batch, user_name ORDER BY ts, event_id, title ROWS UNBOUNDED PRECEDING) AS l2 FROM s1
)"""


@query("corr_temporal_ordered", EV.rstrip() + _STEPS.format("Failed logon", "Logon", titles="'Failed logon', 'Logon'") + f" SELECT event_id, source_batch, user_name FROM s2 WHERE l2 >= ts - INTERVAL {DAY * 3} SECONDS")
def corr_temporal_ordered(spark, sf_dir):
    return _fired(spark, sf_dir, rule("temporal_ordered", ("Failed logon", "Logon"), DAY * 3)).drop("n")


@query("corr_temporal_ordered_3", EV.rstrip() + _STEPS.format("Failed logon", "Logon", titles="'Failed logon', 'Logon', 'New account'") + """, s3 AS (
  SELECT *, max(CASE WHEN title = 'New account' THEN l2 END) OVER (PARTITION BY source_batch, user_name ORDER BY ts, event_id, title ROWS UNBOUNDED PRECEDING) AS l3 FROM s2
) SELECT event_id, source_batch, user_name FROM s3 WHERE l3 >= ts - INTERVAL """ + f"{DAY * 6} SECONDS")  # fmt: skip
def corr_temporal_ordered_3(spark, sf_dir):
    return _fired(spark, sf_dir, rule("temporal_ordered", ("Failed logon", "Logon", "New account"), DAY * 6)).drop("n")


@query("corr_ordered_final_anchor", EV + f"""SELECT event_id, source_batch, user_name FROM (
  SELECT *, max(CASE WHEN title = 'Failed logon' THEN ts END) OVER (PARTITION BY source_batch, user_name ORDER BY ts, event_id, title ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM hit WHERE title IN ('Failed logon', 'Logon')) WHERE title = 'Logon' AND b >= ts - INTERVAL {DAY * 3} SECONDS""")
def corr_ordered_final_anchor(spark, sf_dir):
    return _fired(spark, sf_dir, rule("temporal_ordered", ("Failed logon", "Logon"), DAY * 3), final_step_only=True).drop("n")


@query("corr_anchor_latest", EV + f"""SELECT a.event_id, a.source_batch, a.user_name, count(*) AS n FROM hit a JOIN (SELECT source_batch, user_name, max(ts) AS ts FROM hit WHERE title = 'Failed logon' GROUP BY 1, 2) l
  ON a.source_batch = l.source_batch AND a.user_name = l.user_name AND a.ts = l.ts AND a.title = 'Failed logon'
  JOIN hit b ON b.source_batch = a.source_batch AND b.user_name = a.user_name AND b.title = 'Failed logon' AND b.ts BETWEEN a.ts - INTERVAL {DAY * 5} SECONDS AND a.ts GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def corr_anchor_latest(spark, sf_dir):
    return _fired(spark, sf_dir, rule("event_count", ("Failed logon",), DAY * 5, {"gte": 2}), anchors="latest_in_batch")


@query("corr_numeric_key", EV + f"SELECT event_id, CAST(code AS VARCHAR) AS code, host, n FROM (SELECT *, count(*) OVER (PARTITION BY source_batch, code, host ORDER BY ts RANGE BETWEEN INTERVAL {DAY} SECONDS PRECEDING AND CURRENT ROW) AS n FROM hit WHERE title = 'Failed logon') WHERE n >= 3")
def corr_numeric_key(spark, sf_dir):
    c = rule("event_count", ("Failed logon",), DAY, {"gte": 3}, ("EventID", "Hostname"))
    return C.evaluate(hits(spark, sf_dir, c.group_by), c).select("event_id", F.col("k0").alias("code"), F.col("k1").alias("host"), "n")


@query("corr_multi_key", EV + f"SELECT event_id, host, ip, n FROM (SELECT *, count(*) OVER (PARTITION BY source_batch, host, ip ORDER BY ts RANGE BETWEEN INTERVAL {DAY * 3} SECONDS PRECEDING AND CURRENT ROW) AS n FROM hit WHERE title IN ('Failed logon', 'Logon')) WHERE n > 3")
def corr_multi_key(spark, sf_dir):
    c = rule("event_count", ("Failed logon", "Logon"), DAY * 3, {"gt": 3}, ("Hostname", "IpAddress"))
    return C.evaluate(hits(spark, sf_dir, c.group_by), c).select("event_id", F.col("k0").alias("host"), F.col("k1").alias("ip"), "n")


@query("corr_chain", EV + f""", child AS (
  SELECT DISTINCT source_batch, user_name, ts, 'Burst' AS title, 'corr' AS event_id FROM (SELECT *, count(*) OVER ({_KEYED.format(span=DAY * 5)}) AS n FROM hit WHERE title = 'Failed logon') WHERE n >= 2
), pool AS (
  SELECT source_batch, user_name, ts, title, event_id FROM child UNION ALL SELECT source_batch, user_name, ts, title, event_id FROM hit WHERE title = 'Logon'
), w AS (
  SELECT *, max(CASE WHEN title = 'Burst' THEN ts END) OVER (PARTITION BY source_batch, user_name ORDER BY ts, title ROWS UNBOUNDED PRECEDING) AS l1 FROM pool
), x AS (
  SELECT *, max(CASE WHEN title = 'Logon' THEN l1 END) OVER (PARTITION BY source_batch, user_name ORDER BY ts, title ROWS UNBOUNDED PRECEDING) AS l2 FROM w
) SELECT source_batch, user_name, CAST(count(*) AS BIGINT) AS n FROM x WHERE l2 >= ts - INTERVAL {DAY * 2} SECONDS GROUP BY 1, 2""")
def corr_chain(spark, sf_dir):
    child = Correlation("c1", "Burst", "event_count", ("TargetUserName",), DAY * 5, {"gte": 2}, (("Failed logon", "rule"),), "medium")
    parent = Correlation("c2", "Logon after burst", "temporal_ordered", ("TargetUserName",), DAY * 2, {}, (("Burst", "correlation"), ("Logon", "rule")), "high")
    fired, _ = C.correlate(hits(spark, sf_dir), [parent, child])
    return fired["Logon after burst"].groupBy("source_batch", F.col("k0").alias("user_name")).agg(F.count("*").alias("n"))


#: Ten rules over four key lists: kind, titles, span in days, condition, key column in SQL and field.
_MANY = (
    ("event_count", ("Failed logon",), 3, {"gte": 2}, "user_name"), ("event_count", ("Failed logon", "Logon"), 1, {"gt": 3}, "host"), ("event_count", ("New account",), 5, {"eq": 2}, "user_name"),
    ("event_count", ("Failed logon",), 2, {"lte": 1}, "ip"), ("event_count", ("Logon",), 1, {"gte": 2, "lt": 5}, "image"), ("value_count", ("Failed logon",), 10, {"gte": 3}, "user_name"),
    ("value_count", ("Logon",), 1, {"neq": 2}, "host"), ("temporal", ("Failed logon", "Logon"), 2, {}, "user_name"), ("temporal", ("Failed logon", "Logon", "New account"), 1, {}, "host"), ("temporal_ordered", ("Failed logon", "Logon"), 3, {}, "user_name"),
)
_KEY_FIELD = {"user_name": "TargetUserName", "host": "Hostname", "ip": "IpAddress", "image": "Image"}


def _many_rules() -> list[Correlation]:
    return [rule(kind, titles, days * DAY, condition | ({"field": "Image"} if kind == "value_count" else {}), (_KEY_FIELD[key],), id=f"m{i}", title=f"Many {i}") for i, (kind, titles, days, condition, key) in enumerate(_MANY)]


def _many_sql(since: str = "") -> str:
    parts, steps = [], []
    sign = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<", "eq": "=", "neq": "<>"}
    for i, (kind, titles, days, condition, key) in enumerate(_MANY):
        some = ", ".join(f"'{t}'" for t in titles)
        n = {"event_count": "count(*)", "value_count": "count(DISTINCT image)"}.get(kind, "count(DISTINCT title)")
        met = " AND ".join(f"n {sign[k]} {v}" for k, v in condition.items()) or f"n >= {len(titles)}"
        frame = f"PARTITION BY source_batch, {key} ORDER BY ts RANGE BETWEEN INTERVAL {days * DAY} SECONDS PRECEDING AND CURRENT ROW"
        if kind == "temporal_ordered":
            order = f"PARTITION BY source_batch, {key} ORDER BY ts, event_id, title ROWS UNBOUNDED PRECEDING"
            steps.append(f", a{i} AS (SELECT *, max(CASE WHEN title = '{titles[0]}' THEN ts END) OVER ({order}) AS l1 FROM hit WHERE title IN ({some})), b{i} AS (SELECT *, max(CASE WHEN title = '{titles[1]}' THEN l1 END) OVER ({order}) AS l2, {n} OVER ({frame}) AS n FROM a{i})")
            parts.append(f"SELECT 'Many {i}' AS correlation, event_id, title AS rule_title, source_batch, {key} AS key, n, ts FROM b{i} WHERE l2 >= ts - INTERVAL {days * DAY} SECONDS AND {met}")
        else:
            parts.append(f"SELECT 'Many {i}' AS correlation, event_id, title AS rule_title, source_batch, {key} AS key, n, ts FROM (SELECT *, {n} OVER ({frame}) AS n FROM hit WHERE title IN ({some})) WHERE {met}")
    return EV.rstrip() + "".join(steps) + f" SELECT correlation, event_id, rule_title, source_batch, key, n FROM ({' UNION ALL '.join(parts)}){since}"


def _many_hits(spark, sf_dir) -> DataFrame:
    return C.ledger(matched(spark, sf_dir), C.hit_spec(_many_rules()))


@query("corr_many", _many_sql())
def corr_many(spark, sf_dir):
    """Ten rules in one pass."""
    rules = _many_rules()
    out = joint.evaluate_all(_many_hits(spark, sf_dir), rules)
    return out.select(joint.Rules(rules).head(F.col("rule"))["title"].alias("correlation"), "event_id", "rule_title", "source_batch", F.col("keys")[0].alias("key"), "n")


_LATE = ("m0", "m1", "m5", "m7", "m8", "m9")


@query("corr_late_hits", _many_sql().replace("SELECT correlation, event_id, rule_title, source_batch, key, n FROM (", "SELECT DISTINCT correlation, source_batch, key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM (") + " WHERE correlation IN (" + ", ".join(f"'Many {x[1]}'" for x in _LATE) + ")")
def corr_late_hits(spark, sf_dir):
    """The ledger comes in three parts, the latest first, by a hash: what fires over all of them is what fires at once."""
    rules = [c for c in _many_rules() if c.id in _LATE]
    work = _folder(spark, "late")
    every = land(_many_hits(spark, sf_dir).withColumn("part_", F.pmod(F.xxhash64("event_id"), F.lit(3))), f"{work}/hits", ("event_ts",))
    own = None
    for part in range(3):
        stored = every.where(F.col("part_") <= part).drop("part_")
        fired = joint.evaluate_all(stored, rules, new_hits=every.where(F.col("part_") == part).drop("part_"))
        fired = land(fired, f"{work}/fired{part}")
        own = fired if own is None else own.unionByName(fired)
    title = joint.Rules(rules).head(F.col("rule"))["title"]
    return own.select(title.alias("correlation"), "source_batch", F.col("keys")[0].alias("key"), F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).distinct()


@query("corr_stream_state", _many_sql().replace("SELECT correlation, event_id, rule_title, source_batch, key, n FROM (", "SELECT DISTINCT correlation, event_id, rule_title, key FROM (") + " WHERE correlation IN ('Many 1', 'Many 8')")
def corr_stream_state(spark, sf_dir):
    """Two rules over the ledger as a stream of three micro-batches, in no order of time, with native state; once for a session and folder. The ledger is made once, and a micro-batch is files of some rows each."""
    rules = [c for c in _many_rules() if c.id in ("m1", "m8")]
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/state-{hashlib.md5(sf_dir.encode(), usedforsecurity=False).hexdigest()}"
    if not exists(spark, f"{path}/done"):
        every = land(C.ledger(matched(spark, sf_dir), C.hit_spec(rules)).withColumn("part_", F.pmod(F.xxhash64("event_id"), F.lit(3))), f"{path}/hits")
        # Files by a hash, so that all parts have as many.
        files = max(1, -(-every.count() // (3 * R.TASK_ROWS)))
        for part in range(3):
            every.where(F.col("part_") == part).drop("part_").repartition(files, F.xxhash64("event_id", "rule_title")).write.mode("append").parquet(f"{path}/in")
        setting = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(setting)
        spark.conf.set(setting, stateful.ROCKS)
        try:
            stream = spark.readStream.schema(C.LEDGER).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
            fired = stateful.correlate_stream(stream, rules, "365 days").select("correlation", "event_id", "rule_title", F.col("keys")[0].alias("key"))
            fired.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(setting, before)
        spark.range(1).write.parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/out").distinct()


@query("corr_window_counts", EV + "SELECT source_batch, host, count(*) AS n FROM hit WHERE title = 'Failed logon' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15' GROUP BY 1, 2")
def corr_window_counts(spark, sf_dir):
    out = C.window_counts(hits(spark, sf_dir, ("Hostname",)), ["Failed logon"], ["Hostname"], "2024-01-05 00:00:00", "2024-01-15 00:00:00")
    return out.select("source_batch", F.col("k0").alias("host"), "n")


@query("corr_alerts", EV + f""", f AS (SELECT *, count(*) OVER ({_KEYED.format(span=DAY * 3)}) AS n FROM hit WHERE title = 'Failed logon'),
 l AS (SELECT source_batch, user_name, max(ts) AS ts FROM f WHERE n >= 2 GROUP BY 1, 2)
 SELECT DISTINCT substr(sha256('c1:' || f.user_name), 1, 16) AS dedup_key, f.source_batch, f.n AS event_count, 'correlation' AS engine FROM f JOIN l USING (source_batch, user_name, ts)""")
def corr_alerts(spark, sf_dir):
    m = matched(spark, sf_dir)
    c = rule("event_count", ("Failed logon",), DAY * 3, {"gte": 2})
    h = C.ledger(m, C.hit_spec([c]))
    return C.fired_alerts(C.evaluate(h, c), c, h, m).select("dedup_key", "source_batch", "event_count", "engine")


_FIRED = EV + f""", f AS (SELECT *, count(*) OVER ({_KEYED.format(span=DAY * 3)}) AS n FROM hit WHERE title = 'Failed logon'),
 l AS (SELECT source_batch, user_name, max(ts) AS ts FROM f WHERE n >= 2 GROUP BY 1, 2),
 w AS (SELECT l.source_batch, l.user_name, h.event_id, h.event_time, h.host, h.ip, row_number() OVER (PARTITION BY l.source_batch, l.user_name ORDER BY h.ts, h.event_id) AS r
   FROM l JOIN hit h ON h.title = 'Failed logon' AND h.source_batch = l.source_batch AND h.user_name = l.user_name AND h.ts BETWEEN l.ts - INTERVAL {DAY * 3} SECONDS AND l.ts)
"""


@query("corr_alert_samples", _FIRED + """SELECT source_batch, user_name, string_agg(event_time, ',' ORDER BY r) AS sample, list_sort(list(DISTINCT host))[1] AS first_host, array_to_string(list_sort(list(DISTINCT ip)), ',') AS ips
FROM w WHERE r <= 10 GROUP BY 1, 2""")
def corr_alert_samples(spark, sf_dir):
    """Entities and the earliest events of each alert's window."""
    m = matched(spark, sf_dir)
    c = rule("event_count", ("Failed logon",), DAY * 3, {"gte": 2})
    h = C.ledger(m, C.hit_spec([c]))
    a = C.fired_alerts(C.evaluate(h, c), c, h, m)
    times = F.transform("sample_events", lambda r: F.get_json_object(r, "$.SystemTime"))
    return a.select("source_batch", F.col("entities.users")[0].alias("user_name"), F.array_join(times, ",").alias("sample"), F.col("entities.hosts")[0].alias("first_host"), F.array_join("entities.src_ips", ",").alias("ips"))


@query("corr_key_window", EV + """SELECT count(*) AS n, (SELECT string_agg(event_time, ',') FROM (SELECT event_time FROM hit WHERE title = 'Failed logon' AND source_batch = 'batch-1' AND host = 'HOST-3' ORDER BY ts, event_id LIMIT 10)) AS sample
FROM hit WHERE title = 'Failed logon' AND source_batch = 'batch-1' AND host = 'HOST-3'""")
def corr_key_window(spark, sf_dir):
    h = hits(spark, sf_dir, ("Hostname",))
    one = C.key_window(h, matched(spark, sf_dir), ["Failed logon"], {"Hostname": "HOST-3"}, "batch-1", "2000-01-01 00:00:00", "2100-01-01 00:00:00")
    return one.select("n", F.array_join(F.transform("sample_events", lambda r: F.get_json_object(r, "$.SystemTime")), ",").alias("sample"))


@query("corr_new_hits", EV + f"SELECT event_id, source_batch, user_name, n FROM (SELECT *, count(*) OVER ({_KEYED.format(span=DAY * 3)}) AS n FROM hit WHERE title = 'Failed logon') WHERE n >= 2 AND ts >= TIMESTAMP '2024-01-25'")
def corr_new_hits(spark, sf_dir):
    """Only the newest hits are anchors; what is read is cut to their keys and windows."""
    h = hits(spark, sf_dir)
    c = rule("event_count", ("Failed logon",), DAY * 3, {"gte": 2})
    out = C.evaluate(h, c, new_hits=h.where("event_ts >= timestamp_ntz '2024-01-25 00:00:00'"))
    return out.select("event_id", "source_batch", F.col("k0").alias("user_name"), "n")


@query("hits_ledger", EV + "SELECT event_id, title AS rule_title, source_batch, user_name AS u, CASE WHEN title = 'Logon' THEN host END AS h FROM hit WHERE title IN ('Failed logon', 'Logon')")
def hits_ledger(spark, sf_dir):
    h = C.ledger(matched(spark, sf_dir), {"Failed logon": ["TargetUserName"], "Logon": ["TargetUserName", "Hostname"]})
    return h.select("event_id", "rule_title", "source_batch", F.col("group_values")["TargetUserName"].alias("u"), F.col("group_values")["Hostname"].alias("h"))


@query("hits_dedup", EV + "SELECT title AS rule_title, count(*) AS n FROM hit WHERE title IN ('Failed logon', 'Logon', 'New account') AND CAST(event_id AS BIGINT) % 2 = 0 GROUP BY 1")
def hits_dedup(spark, sf_dir):
    every = hits(spark, sf_dir)
    stored = every.where(F.col("event_id").cast("long") % 2 == 1)
    return C.append_hits(stored, every.unionByName(every)).groupBy("rule_title").agg(F.count("*").alias("n"))


# Filters

def _filter(name: str, text: str, where: str, on: Callable = promoted):
    QUERIES[name] = lambda spark, sf_dir: ids(on(spark, sf_dir).where(compile_filter(text)))
    SQL[name] = EV + f"SELECT event_id FROM rules WHERE {where}"


_filter("flt_eq", "EventType = error", "event_type = 'error'")
_filter("flt_eq_cased", 'eventid = 4625 and (Hostname = "HOST-7" or Hostname = "host-8")', "code = 4625 AND (host = 'HOST-7' OR host = 'host-8')")
_filter("flt_eq_boolean", "Flag = 1", "flag")
_filter("flt_neq_null", 'Note != "Note view"', "note IS NULL OR note <> 'Note view'")
_filter("flt_contains_ci", "Hostname contains ost-1", "lower(host) LIKE '%ost-1%'")
_filter("flt_in", "EventID in (4625, 1, 'x y')", "code IN (4625, 1)")
_filter("flt_num_cmp", "k >= 50 and k < 70.5", "k >= 50 AND k < 70.5")
_filter("flt_num_prefix", "Latency >= 10 and Latency < 12.5 or Hostname > 0.5", "user_id % 50 >= 10 AND user_id % 50 < 12.5")
_filter("flt_text_cmp", "TargetUserName > user5", "user_name > 'user5'")
_filter("flt_is_null", "Note is null", "note IS NULL")
_filter("flt_not_null", "Note is not null and Missing is null", "note IS NOT NULL")
_filter("flt_not_3vl", "not Note contains ERR", "NOT (lower(note) LIKE '%err%')")
_filter("flt_nested", "(EventType = error or EventType = click) and not (k > 50 or Hostname = HOST-3)", "(event_type = 'error' OR event_type = 'click') AND NOT (k > 50 OR host = 'HOST-3')")
_filter("flt_precedence", "EventType = error or EventType = click and k > 90 and not Flag = 1", "event_type = 'error' OR (event_type = 'click' AND k > 90 AND NOT flag)")
_filter("flt_is_matched", "is_matched = да", "len(titles) > 0", matched)
_filter("flt_is_unmatched", "is_matched != yes", "len(titles) = 0", matched)
_filter("flt_rule_eq", "rule = 'Failed logon'", "list_contains(titles, 'Failed logon')", matched)
_filter("flt_rule_neq", "rule != Logon", "NOT list_contains(titles, 'Logon')", matched)
_filter("flt_rule_contains", "rule contains LOGON", "len(list_filter(titles, lambda x: lower(x) LIKE '%logon%')) > 0", matched)
_filter("flt_rule_in", "rule in (Logon, 'Busy host')", "list_has_any(titles, ['Logon', 'Busy host'])", matched)
_filter("flt_rule_count", "rule >= 2", "len(titles) >= 2", matched)
_filter("flt_rule_null", "rule is null", "len(titles) = 0", matched)


@query("flt_envelope", EV + "SELECT event_id FROM rules WHERE source_batch = 'batch-1' AND len(titles) > 0 AND event_time BETWEEN '2024-01-05T00:00:00' AND '2024-01-20' AND k > 10 AND host = 'HOST-3'")
def flt_envelope(spark, sf_dir):
    conditions = [{"field": "Hostname", "value": "HOST-3"}, {"field": " ", "op": "eq", "value": "x"}, {"field": "k", "op": "like", "value": "1"}]
    return ids(matched(spark, sf_dir).where(E.event_filter("batch-1", True, "2024-01-05 00:00:00", "2024-01-20Z", "k > 10", conditions, stored=True)))


@query("flt_documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR lang = 'de' AND n_chars > 5000")
def flt_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("raw", F.to_json(F.struct("text", "lang", "n_chars")))
    return d.where(compile_filter("text contains WorthLess or lang = de and n_chars > 5000")).select("doc_id")


# Pages, facets, batches

@query("facet_json_field", EV + "SELECT CAST(k AS VARCHAR) AS value, count(*) AS n FROM ev GROUP BY k ORDER BY n DESC, value NULLS LAST LIMIT 20")
def facet_json_field(spark, sf_dir):
    return E.facet(promoted(spark, sf_dir), "k", 20).select("value", "n")


@query("facet_total", EV + "SELECT count(*) AS total_groups FROM (SELECT DISTINCT note FROM ev)")
def facet_total(spark, sf_dir):
    return E.facet_total(promoted(spark, sf_dir), "Note")


@query("facet_rule_unnest", EV + "SELECT t.title AS value, count(*) AS n FROM rules LEFT JOIN (SELECT event_id, unnest(titles) AS title FROM rules) t ON rules.event_id = t.event_id GROUP BY 1")
def facet_rule_unnest(spark, sf_dir):
    return E.facet(matched(spark, sf_dir), "rule").select("value", "n")


@query("facet_is_matched", EV + "SELECT CASE WHEN len(titles) > 0 THEN 'true' ELSE 'false' END AS value, count(*) AS n FROM rules GROUP BY 1")
def facet_is_matched(spark, sf_dir):
    return E.facet(matched(spark, sf_dir), "is_matched").select("value", "n")


@query("list_events_page", EV + "SELECT event_id, host, note FROM ev WHERE event_type = 'click' ORDER BY event_time DESC, event_id LIMIT 50 OFFSET 25")
def list_events_page(spark, sf_dir):
    page = E.list_events(promoted(spark, sf_dir).withColumn("is_matched", F.lit(False)), "event_time", True, ["Note", "Missing"], 50, 25, query="EventType = click", stored=True)
    return page.select("event_id", "host", F.col("extra")["Note"].alias("note"))


@query("list_events_sort_json", EV + "SELECT event_id, note FROM ev ORDER BY note NULLS FIRST, event_id LIMIT 100")
def list_events_sort_json(spark, sf_dir):
    page = E.list_events(promoted(spark, sf_dir).withColumn("is_matched", F.lit(False)), "Note", False, ["Note"], 100)
    return page.select("event_id", F.col("extra")["Note"].alias("note"))


@query("seek_events_page", EV + "SELECT event_id, host, note FROM ev WHERE event_type = 'click' ORDER BY event_time DESC, event_id LIMIT 50 OFFSET 25")
def seek_events_page(spark, sf_dir):
    """The page of list_events_page, found by the last row of the page before it."""
    e = promoted(spark, sf_dir).withColumn("is_matched", F.lit(False))
    before = last_cursor(E.seek_events(e, None, "event_time", True, limit=25, query="EventType = click", stored=True))
    page = E.seek_events(e, before, "event_time", True, ["Note"], 50, query="EventType = click", stored=True)
    return page.select("event_id", "host", F.col("extra")["Note"].alias("note"))


@query("seek_events_json", EV + "SELECT event_id, note FROM ev ORDER BY note DESC NULLS LAST, event_id LIMIT 100 OFFSET 60")
def seek_events_json(spark, sf_dir):
    """By a field of the events, which many have in common and some lack."""
    e = promoted(spark, sf_dir).withColumn("is_matched", F.lit(False))
    before = last_cursor(E.seek_events(e, None, "Note", True, limit=60))
    return E.seek_events(e, before, "Note", True, ["Note"], 100).select("event_id", F.col("extra")["Note"].alias("note"))


@query("count_events", EV + "SELECT count(*) AS total FROM ev WHERE k < 30")
def count_events(spark, sf_dir):
    return E.count_events(promoted(spark, sf_dir), query="k < 30", stored=True)


@query("time_range", EV + "SELECT event_id FROM ev WHERE event_time >= '2024-01-10T00:00:00' AND event_time <= '2024-01-12T12:00:00'")
def time_range(spark, sf_dir):
    return ids(promoted(spark, sf_dir).where(E.event_filter(time_from="2024-01-10 00:00:00", time_to="2024-01-12T12:00:00Z", stored=True)))


@query("get_event", EV + "SELECT event_id, host, user_name, ip AS src_ip, CAST(code AS VARCHAR) AS event_code FROM ev WHERE event_id = '77'")
def get_event(spark, sf_dir):
    return E.get_event(promoted(spark, sf_dir), "77").select("event_id", "host", "user_name", "src_ip", "event_code")


@query("promoted_columns", EV + "SELECT event_id, host, event_time, user_name, ip AS src_ip, image AS process, CAST(code AS VARCHAR) AS event_code FROM ev")
def promoted_columns(spark, sf_dir):
    return promoted(spark, sf_dir).select("event_id", "host", "event_time", "user_name", "src_ip", "process", "event_code")


@query("first_present", EV + "SELECT event_id, coalesce(CASE WHEN k <> 0 THEN CAST(k AS VARCHAR) END, note, user_name) AS v, CASE WHEN flag THEN 'True' ELSE host END AS f FROM ev")
def first_present(spark, sf_dir):
    r = F.col("raw")
    return raw_events(spark, sf_dir).select("event_id", J.first_present(r, ["Nothing", "k", "Note", "TargetUserName"]).alias("v"), J.first_present(r, ["Flag", "Hostname"]).alias("f"))


@query("source_split", EV + "SELECT source_batch, count(*) AS n, 'mixed:3-sources' AS label FROM ev GROUP BY 1")
def source_split(spark, sf_dir):
    e = landed(spark, sf_dir)
    return e.groupBy("source_batch").agg(F.count("*").alias("n")).withColumn("label", F.lit(E.batch_label(e)))


_ALERTS = EV + """, lv AS (SELECT *, CASE title WHEN 'Failed logon' THEN 'medium' WHEN 'Logon' THEN 'low' ELSE 'high' END AS rule_level, CASE title WHEN 'Failed logon' THEN 'r1' WHEN 'Logon' THEN 'r2' ELSE 'r3' END AS rule_id FROM hit WHERE title <> 'Busy host'),
al AS (SELECT rule_id, title, host, source_batch, rule_level, count(*) AS event_count, list_sort(list(DISTINCT user_name)) AS users, list_sort(list(DISTINCT ip)) AS ips, substr(sha256(rule_id || ':' || host || ':' || min(user_name)), 1, 16) AS dedup_key FROM lv GROUP BY 1, 2, 3, 4, 5)
"""


def alerts(spark: SparkSession, sf_dir: str, samples: bool = False) -> DataFrame:
    return A.group_matches(M.matches(matched(spark, sf_dir)), with_samples=samples)


@query("alerts_group", _ALERTS + "SELECT rule_id, title AS rule_title, host, source_batch, rule_level, event_count FROM al")
def alerts_group(spark, sf_dir):
    return alerts(spark, sf_dir).select("rule_id", "rule_title", "host", "source_batch", "rule_level", "event_count")


@query("alerts_dedup_key", _ALERTS + "SELECT rule_id, host, source_batch, dedup_key FROM al")
def alerts_dedup_key(spark, sf_dir):
    return alerts(spark, sf_dir).select("rule_id", "host", "source_batch", "dedup_key")


@query("alert_entities", _ALERTS + "SELECT rule_id, host, source_batch, array_to_string(users, ',') AS users, array_to_string(ips, ',') AS ips FROM al")
def alert_entities(spark, sf_dir):
    return alerts(spark, sf_dir).select("rule_id", "host", "source_batch", F.array_join("entities.users", ",").alias("users"), F.array_join("entities.src_ips", ",").alias("ips"))


@query("alert_sample_head_tail", _ALERTS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY rule_id, host, source_batch ORDER BY event_time, event_id) AS pos, count(*) OVER (PARTITION BY rule_id, host, source_batch) AS c FROM lv)
SELECT rule_id, host, source_batch, string_agg(user_name || '@' || event_time, ',' ORDER BY pos) AS sample FROM rk WHERE c <= 10 OR pos <= 5 OR pos > c - 5 GROUP BY 1, 2, 3""")
def alert_sample_head_tail(spark, sf_dir):
    said = F.transform("sample_events", lambda r: F.concat(F.get_json_object(r, "$.TargetUserName"), F.lit("@"), F.get_json_object(r, "$.SystemTime")))
    return alerts(spark, sf_dir, True).select("rule_id", "host", "source_batch", F.array_join(said, ",").alias("sample"))


@query("alert_techniques", _ALERTS + "SELECT rule_id, host, source_batch, CASE rule_id WHEN 'r1' THEN 'attack.t1110' WHEN 'r2' THEN 'attack.t1078' ELSE 'attack.t1136.001' END AS techniques FROM al")
def alert_techniques(spark, sf_dir):
    return alerts(spark, sf_dir).select("rule_id", "host", "source_batch", F.array_join("mitre_techniques", ",").alias("techniques"))


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = alerts(spark, sf_dir).withColumn("sample_events", F.array("host"))
    first = A.upsert(a.limit(0), a.where("source_batch = 'batch-0'"))
    return first, a.where("source_batch != 'batch-0'")


_UPSERT = _ALERTS + """, old AS (SELECT * FROM al WHERE source_batch = 'batch-0'), new AS (SELECT dedup_key, sum(event_count) AS total, arg_max(event_count, source_batch) AS latest, min(source_batch) AS b FROM al WHERE source_batch <> 'batch-0' GROUP BY 1)
SELECT coalesce(old.dedup_key, new.dedup_key) AS dedup_key, coalesce(old.source_batch, new.b) AS source_batch, CAST({} AS BIGINT) AS event_count FROM old FULL JOIN new ON old.dedup_key = new.dedup_key"""


@query("alerts_upsert_add", _UPSERT.format("coalesce(old.event_count, 0) + coalesce(new.total, 0)"))
def alerts_upsert_add(spark, sf_dir):
    return A.upsert(*_stored(spark, sf_dir), add=True).select("dedup_key", "source_batch", "event_count")


@query("alerts_upsert_overwrite", _UPSERT.format("coalesce(new.latest, old.event_count)"))
def alerts_upsert_overwrite(spark, sf_dir):
    return A.upsert(*_stored(spark, sf_dir), add=False).select("dedup_key", "source_batch", "event_count")


@query("alerts_sort_severity", _ALERTS + "SELECT rule_id, host, source_batch, event_count FROM al WHERE source_batch = 'batch-1' ORDER BY CASE rule_level WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END DESC, dedup_key LIMIT 30")
def alerts_sort_severity(spark, sf_dir):
    return A.list_alerts(alerts(spark, sf_dir, True), "batch-1", sort_by="rule", limit=30).select("rule_id", "host", "source_batch", "event_count")


@query("seek_alerts_page", _ALERTS + "SELECT rule_id, host, source_batch, event_count FROM al WHERE source_batch = 'batch-1' ORDER BY CASE rule_level WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END DESC, dedup_key LIMIT 20 OFFSET 10")
def seek_alerts_page(spark, sf_dir):
    a = alerts(spark, sf_dir, True)
    before = last_cursor(A.seek_alerts(a, None, "rule", limit=10, source_batch="batch-1"))
    return A.seek_alerts(a, before, "rule", limit=20, source_batch="batch-1").select("rule_id", "host", "source_batch", "event_count")


@query("alerts_merged_on_read", _ALERTS + "SELECT dedup_key, min(source_batch) AS source_batch, CAST(sum(event_count) AS BIGINT) AS event_count FROM al GROUP BY 1")
def alerts_merged_on_read(spark, sf_dir):
    """The alerts of three batches, each added as a part of its own, the first two merged when the second comes."""
    a = alerts(spark, sf_dir).withColumn("sample_events", F.array("host"))
    columns = ("dedup_key", "engine", "source_batch", "host", "rule_id", "rule_title", "rule_level", "event_count", "sample_events", "status")
    kinds = {"event_count": "bigint", "sample_events": "array<string>"}
    table = AlertTable(spark, _folder(spark, "alerts"), ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns), fan=2)
    for i in range(3):
        table.upsert(a.where(F.col("source_batch") == f"batch-{i}").select(*columns), True, {"last_batch": i})
    return table.read().select("dedup_key", "source_batch", "event_count")


@query("batches_sealed_and_expired", EV + "SELECT source_batch, count(*) AS n, min(event_time) AS first_at FROM ev WHERE event_time >= '2024-01-15' GROUP BY 1")
def batches_sealed_and_expired(spark, sf_dir):
    """Events as three micro-batches, sealed into parts one after the other, less those that came before a day."""
    e = raw_events(spark, sf_dir).select("event_id", "source_batch", "ingested_at", "raw")
    path = _folder(spark, "sealed")
    table = BatchTable(spark, path, e.withColumn("micro_batch", F.lit(0).cast("bigint")).schema, ("ingested_at",), fan=2)
    for i in range(3):
        append_once(e.where(F.col("source_batch") == f"batch-{i}"), path, i, ("ingested_at",))
        table.seal(i)
    table.keep(lambda rows: E.retention_split(rows, "2024-01-15")[0])
    return table.read().groupBy("source_batch").agg(F.count("*").alias("n"), F.min("ingested_at").alias("first_at"))


@query("batch_summary", _ALERTS + ", c AS (SELECT source_batch, count(*) AS alert_count FROM al GROUP BY 1) SELECT r.source_batch, count(*) AS event_count, CAST(sum(CASE WHEN len(titles) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS matched_count, min(event_time) AS first_ingested, max(event_time) AS last_ingested, any_value(alert_count) AS alert_count FROM rules r JOIN c ON r.source_batch = c.source_batch GROUP BY 1")
def batch_summary(spark, sf_dir):
    return E.batch_summary(matched(spark, sf_dir), alerts(spark, sf_dir))


@query("source_summary", EV + "SELECT s.name, coalesce(n, 0) AS event_count FROM (VALUES ('batch-0'), ('batch-2'), ('other')) s(name) LEFT JOIN (SELECT source_batch, count(*) AS n FROM ev GROUP BY 1) b ON s.name = b.source_batch")
def source_summary(spark, sf_dir):
    sources = spark.createDataFrame([("batch-0",), ("batch-2",), ("other",)], "name string")
    return E.source_summary(sources, E.batch_summary(matched(spark, sf_dir), alerts(spark, sf_dir))).select("name", "event_count")


@query("retention_split", EV + "SELECT event_time < '2024-01-15' AS removed, count(*) AS n FROM ev GROUP BY 1")
def retention_split(spark, sf_dir):
    kept, gone = E.retention_split(raw_events(spark, sf_dir), "2024-01-15")
    return kept.select(F.lit(False).alias("removed")).unionByName(gone.select(F.lit(True).alias("removed"))).groupBy("removed").agg(F.count("*").alias("n"))


@query("orphan_hits", EV + "SELECT title AS rule_title, count(*) AS n FROM hit WHERE title <> 'Busy host' AND event_time >= '2024-01-15' GROUP BY 1")
def orphan_hits(spark, sf_dir):
    kept, _ = E.retention_split(raw_events(spark, sf_dir), "2024-01-15")
    return E.without_orphans(hits(spark, sf_dir), kept).groupBy("rule_title").agg(F.count("*").alias("n"))


@query("delete_batch", EV + "SELECT source_batch, count(*) AS n FROM ev WHERE source_batch <> 'batch-1' GROUP BY 1")
def delete_batch(spark, sf_dir):
    return E.delete_batch(raw_events(spark, sf_dir), "batch-1").groupBy("source_batch").agg(F.count("*").alias("n"))


@query("health", _ALERTS + "SELECT 'events' AS name, count(*) AS n FROM ev UNION ALL SELECT 'alerts', count(*) FROM al")
def health(spark, sf_dir):
    return E.health(raw_events(spark, sf_dir), alerts(spark, sf_dir))


# Rules

def _sigma(name: str, detection: dict, where: str, lists: dict | None = None, **more):
    def run(spark, sf_dir):
        r = compile_rule({"id": name, "title": name, "detection": detection})[0]
        return ids(raw_events(spark, sf_dir).where(r.predicate(F.col("raw"), (lists or {}).get, **more)))

    QUERIES[name] = run
    SQL[name] = EV + f"SELECT event_id FROM ev WHERE {where}"


_sigma("sigma_selection_and_or", {"a": {"EventType": ["ERROR", "click"], "k": 7}, "b": [{"Hostname": "host-3", "EventID": 1}, {"EventID": 4720, "k": 9}], "condition": "a or b"}, "(event_type IN ('error', 'click') AND k = 7) OR (host = 'HOST-3' AND code = 1) OR (code = 4720 AND k = 9)")
_sigma("sigma_endswith_list", {"s": {"Image|endswith": ["\\App7.exe", "\\app12.exe"]}, "condition": "s"}, "lower(image) LIKE '%app7.exe' OR lower(image) LIKE '%app12.exe'")
_sigma("sigma_startswith", {"s": {"Image|startswith": "c:\\tools\\app1"}, "condition": "s"}, "lower(image) LIKE 'c:_tools_app1%'")
_sigma("sigma_contains", {"s": {"Note|contains": "RR"}, "condition": "s"}, "lower(note) LIKE '%rr%'")
_sigma("sigma_two_modifiers", {"s": {"Image|contains": "app1", "Image|endswith": "5.exe"}, "condition": "s"}, "lower(image) LIKE '%app1%' AND lower(image) LIKE '%5.exe'")
_sigma("sigma_regex", {"s": {"Hostname|re": "^HOST-1[0-4]$"}, "condition": "s"}, "regexp_matches(host, '^HOST-1[0-4]$')")
_sigma("sigma_cased", {"s": {"EventType|cased": ["Error", "click"]}, "condition": "s"}, "event_type = 'click'")
_sigma("sigma_all", {"s": {"Image|contains|all": ["tools", "app3", ".exe"]}, "condition": "s"}, "lower(image) LIKE '%app3%'")
_sigma("sigma_exists", {"s": {"Note|exists": False}, "t": {"k|exists": True}, "condition": "s and t"}, "note IS NULL AND k IS NOT NULL")
_sigma("sigma_null", {"s": {"Note": None}, "t": {"Hostname": ""}, "condition": "s and not t"}, "note IS NULL AND NOT host = ''")
_sigma("sigma_numeric_list", {"s": {"k": [3, 14, 15, 92]}, "condition": "s"}, "k IN (3, 14, 15, 92)")
_sigma("sigma_gt", {"s": {"k|gt": 40, "UserId|lte": 100}, "condition": "s"}, "k > 40 AND user_id <= 100")
_sigma("sigma_1_of", {"sel_a": {"k": 1}, "sel_b": {"EventType": "signup", "k|lt": 20}, "other": {"k": 5}, "condition": "1 of sel_*"}, "k = 1 OR (event_type = 'signup' AND k < 20)")
_sigma("sigma_all_of", {"a": {"k|gte": 10}, "b": {"EventType": "view"}, "condition": "all of them"}, "k >= 10 AND event_type = 'view'")
_sigma("sigma_2_of", {"a": {"k|gte": 50}, "b": {"EventType": "view"}, "c": {"Flag": True}, "condition": "2 of them"}, "(CASE WHEN k >= 50 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) + (CASE WHEN flag THEN 1 ELSE 0 END) >= 2")
_sigma("sigma_not_filter", {"s": {"EventID": 4625}, "filter": {"Note|contains": "zzz"}, "condition": "s and not filter"}, "code = 4625 AND note IS NOT NULL")
_sigma("sigma_not_filter_nulls_match", {"s": {"EventID": 4625}, "filter": {"Note|contains": "zzz"}, "condition": "s and not filter"}, "code = 4625", nulls_match=True)
_sigma("sigma_grouped_filters", {"s": {"EventID": 4625}, "t": {"EventID": 1}, "filter_a_x": {"Hostname": "HOST-1"}, "filter_a_y": {"Hostname": "HOST-2"}, "filter_b_x": {"k|gt": 50}, "condition": "(s and not 1 of filter_a_*) or (t and not 1 of filter_b_*)"}, "(code = 4625 AND host NOT IN ('HOST-1', 'HOST-2')) OR (code = 1 AND NOT k > 50)")
_sigma("sigma_fieldref", {"s": {"k|fieldref": "UserId"}, "condition": "s"}, "CAST(k AS VARCHAR) = CAST(user_id AS VARCHAR)")
_sigma("sigma_windash", {"s": {"Hostname|windash|contains": "HOST -3"}, "t": {"Hostname|endswith|windash": "-3"}, "condition": "s or t"}, "host LIKE '%-3'")
_sigma("sigma_wildcard", {"s": {"Image": "*\\app?.exe", "Hostname": "host-1*"}, "condition": "s"}, "regexp_matches(lower(image), 'app.[.]exe$') AND host LIKE 'HOST-1%'")
_sigma("sigma_cidr", {"s": {"IpAddress|cidr": ["10.0.0.0/29", "10.0.0.32/28"]}, "condition": "s"}, "user_id % 50 < 8 OR user_id % 50 BETWEEN 32 AND 47")
_sigma("sigma_cidr_20000", {"s": {"IpAddress|cidr": [f"10.{i >> 13}.{i >> 5 & 255}.{i % 32 * 8}/30" for i in range(20_000)] + ["fe80::/10", "2001:db8::/96"]}, "condition": "s"}, "user_id % 50 % 8 < 4")
_sigma("sigma_base64offset", {"s": {"Blob|base64offset|contains": "app7.exe"}, "t": {"Blob|base64": "cmd app9.exe"}, "condition": "s or t"}, "tool IN (7, 9)")
_sigma("sigma_utf16", {"s": {"Wide|utf16le|contains": "rr"}, "t": {"Wide|wide": "view"}, "condition": "s or t"}, "event_type IN ('error', 'view')")
_sigma("sigma_keywords", {"words": ["note CLICK", "HOST-19"], "condition": "words"}, "lower(note) LIKE '%note click%' OR host = 'HOST-19'")
_sigma("value_list_expand", {"s": {"TargetUserName|expand": ["%admins%", "user9"]}, "condition": "s"}, "user_name IN ('user1', 'user2', 'user33', 'user9')", {"admins": ["user1", "USER2", "user33"]})


@query("value_list_semi_join", EV + "SELECT event_id FROM ev WHERE user_name IN (SELECT 'user' || (i * 7) FROM range(100) r(i))")
def value_list_semi_join(spark, sf_dir):
    values = spark.range(100).select(F.concat(F.lit("USER"), (F.col("id") * 7).cast("string")).alias("value"))
    return ids(M.in_values(raw_events(spark, sf_dir), "TargetUserName", values))


@query("rule_pack_match", EV + "SELECT title AS rule_title, host, count(*) AS n FROM hit GROUP BY 1, 2")
def rule_pack_match(spark, sf_dir):
    return M.matches(M.match(promoted(spark, sf_dir), pack())).groupBy("rule_title", "host").agg(F.count("*").alias("n"))


def big_pack(n: int = 2000) -> list[Rule]:
    """Rules that each list one file name, as large packs mostly do."""
    return [r for i in range(n) for r in compile_rule({"id": f"b{i}", "title": f"Tool {i}", "level": "high", "detection": {"s": {"Image|endswith": f"\\APP{i}.exe"}, "condition": "s"}})]


@query("rule_pack_2000", EV + "SELECT event_id, 'Tool ' || (CAST(event_id AS BIGINT) % 40) AS title FROM ev")
def rule_pack_2000(spark, sf_dir):
    return M.match_literals(promoted(spark, sf_dir), big_pack()).select("event_id", "title")


@query("rule_pack_routed", EV + "SELECT event_id, 'P' || (k % 30) || '-' || code AS title FROM ev WHERE k IS NOT NULL AND code IN (1, 3, 4625)")
def rule_pack_routed(spark, sf_dir):
    rules = [Rule(f"p{i}-{code}", f"P{i}-{code}", "low", eventid=(code,), detection={"s": {"k": list(range(i, 1000, 30))}, "condition": "s"}) for code in (1, 3, 4625) for i in range(30)]
    return M.matches(M.match(promoted(spark, sf_dir), rules)).select("event_id", F.col("rule_title").alias("title"))


def mixed_pack(n: int = 4300) -> list[Rule]:
    """Rules that take parts of texts, wildcards, several selections and filters: none is a list of literals of one field."""
    out = []
    for i in range(n):
        d = (
            {"s": {"Image|contains": f"\\APP{i}.", "Hostname|endswith": ["-7", "-3"]}, "condition": "s"},
            {"s": {"Image": f"*\\app{i}.e?e"}, "f": {"EventType": ["error", "click"]}, "condition": "s and not f"},
            {"s": {"TargetUserName|startswith": f"user{i}"}, "t": {"Note|contains": "ERR"}, "condition": "s and not t"},
            {"a": {"Image|contains|all": ["tools", f"app{i}.exe"]}, "b": [f"note {i}", f"HOST-{i}\""], "condition": "all of them"},
        )[i % 4]
        out += compile_rule({"id": f"m{i}", "title": f"Mixed {i}", "level": "low", "detection": d})
    return out


@query("rule_pack_4300", EV.rstrip() + """, n AS (SELECT i FROM range(4300) r(i)), m AS (
  SELECT event_id, i FROM ev JOIN n ON i = tool WHERE i % 4 = 0 AND (host LIKE '%-7' OR host LIKE '%-3')
  UNION ALL SELECT event_id, i FROM ev JOIN n ON i = tool WHERE i % 4 = 1 AND event_type NOT IN ('error', 'click')
  UNION ALL SELECT event_id, i FROM ev JOIN n ON starts_with(user_name, 'user' || i) WHERE i % 4 = 2 AND note IS NOT NULL AND event_type <> 'error'
  UNION ALL SELECT event_id, i FROM ev JOIN n ON i = tool WHERE i % 4 = 3 AND host = 'HOST-' || i
) SELECT event_id, 'Mixed ' || i AS title FROM m""")
def rule_pack_4300(spark, sf_dir):
    return M.matches(M.match(promoted(spark, sf_dir), mixed_pack())).select("event_id", F.col("rule_title").alias("title"))


@query("ruleset_compose", "SELECT lower(r_name) AS ruleset, n_name AS rule_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE CASE WHEN r_regionkey % 2 = 0 THEN n_nationkey % 3 <> 0 ELSE n_nationkey % 4 = 0 END")
def ruleset_compose(spark, sf_dir):
    """Regions are rulesets, nations their rules; some sets are included less some rules, of others some rules are picked."""
    c = Catalog()
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", F.lower("r_name").alias("r"), "n_nationkey", "n_name").collect()
    for x in rows:
        path = f"custom_rulesets/{x.r.replace(' ', '-')}"
        if path not in c.sets:
            c.create_ruleset(x.r)
            if x.r_regionkey % 2 == 0:
                c.toggle_ruleset(path, True)
        c.save_rule(path, {"id": x.n_name, "title": f"Rule {x.n_name}", "detection": {"s": {"EventID": x.n_nationkey}, "condition": "s"}})
        if (x.n_nationkey % 3 == 0) if x.r_regionkey % 2 == 0 else (x.n_nationkey % 4 == 0):
            c.toggle_rule(path, x.n_name, x.r_regionkey % 2 != 0)
    of = {x.n_name: x.r for x in rows}
    return spark.createDataFrame([(of[r.id], r.id) for r in c.main()], "ruleset string, rule_id string")


# Knowledge base

def bundle(spark: SparkSession) -> DataFrame:
    """A small STIX bundle."""
    ref = lambda i: [{"source_name": "other", "external_id": "x", "url": None}, {"source_name": "mitre-attack", "external_id": i, "url": f"https://example.org/{i}"}]
    phase = lambda *names: [{"kill_chain_name": "mitre-attack", "phase_name": n} for n in names]
    o = [
        {"type": "x-mitre-collection", "id": "c", "name": "Enterprise", "x_mitre_version": "1.0"},
        {"type": "x-mitre-matrix", "id": "m", "tactic_refs": ["t2", "t1"]},
        {"type": "x-mitre-tactic", "id": "t1", "name": "Access", "x_mitre_shortname": "access", "external_references": ref("TA0001")},
        {"type": "x-mitre-tactic", "id": "t2", "name": "Execution", "x_mitre_shortname": "execution", "external_references": ref("TA0002")},
        {"type": "x-mitre-tactic", "id": "t3", "name": "Impact", "x_mitre_shortname": "impact", "external_references": ref("TA0040")},
        {"type": "x-mitre-tactic", "id": "t4", "name": "Nameless", "external_references": ref("TA0099")},
        {"type": "attack-pattern", "id": "p1", "name": "Shell", "x_mitre_detection": "Watch it", "x_mitre_data_sources": ["Process: Creation"], "external_references": ref("T1059"), "kill_chain_phases": phase("execution")},
        {"type": "attack-pattern", "id": "p2", "name": "PowerShell", "x_mitre_is_subtechnique": True, "external_references": ref("T1059.001"), "kill_chain_phases": phase("execution")},
        {"type": "attack-pattern", "id": "p3", "name": "Accounts", "external_references": ref("T1078"), "kill_chain_phases": phase("access", "execution")},
        {"type": "attack-pattern", "id": "p4", "name": "Old", "revoked": True, "external_references": ref("T1100"), "kill_chain_phases": phase("access")},
        {"type": "attack-pattern", "id": "p5", "name": "Older", "x_mitre_deprecated": True, "external_references": ref("T1101"), "kill_chain_phases": phase("access")},
        {"type": "course-of-action", "id": "a1", "name": "Signing", "external_references": ref("M1045")},
        {"type": "x-mitre-detection-strategy", "id": "s1", "name": "Watch shells", "external_references": ref("DET0001"), "x_mitre_analytic_refs": ["n1"]},
        {"type": "x-mitre-analytic", "id": "n1", "name": "Analytic 1", "external_references": ref("AN0001")},
        {"type": "intrusion-set", "id": "g1", "name": "Bears", "external_references": ref("G0001")},
        {"type": "malware", "id": "w1", "name": "Worm", "external_references": ref("S0001")},
        {"type": "relationship", "id": "r1", "relationship_type": "mitigates", "source_ref": "a1", "target_ref": "p2"},
        {"type": "relationship", "id": "r2", "relationship_type": "detects", "source_ref": "s1", "target_ref": "p1"},
        {"type": "relationship", "id": "r3", "relationship_type": "uses", "source_ref": "g1", "target_ref": "p2"},
        {"type": "relationship", "id": "r4", "relationship_type": "uses", "source_ref": "w1", "target_ref": "p3"},
        {"type": "relationship", "id": "r5", "relationship_type": "uses", "source_ref": "g1", "target_ref": "p4"},
        {"type": "relationship", "id": "r6", "relationship_type": "mitigates", "source_ref": "nobody", "target_ref": "p1"},
    ]
    import json

    return spark.createDataFrame([(json.dumps(x),) for x in o], "j string").select(F.from_json("j", K.OBJECT).alias("o")).select("o.*")


def table_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STIX objects made of the star schema: regions are tactics, suppliers techniques, some with a sub-technique, nations mitigations and groups."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    ref = lambda c: F.array(F.struct(F.lit("mitre-attack").alias("source_name"), c.alias("external_id")))
    phase = lambda c: F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.lower(c).alias("phase_name")))
    region, nation = read("region"), read("nation")
    supplier = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    s, n, r = F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    kind = lambda t: F.lit(t).alias("type")
    parts = [
        region.select(F.struct(kind("x-mitre-tactic"), said("t", r).alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("x_mitre_shortname"), ref(said("TA000", r)).alias("external_references"))),
        region.where("r_regionkey > 0").agg(F.array_sort(F.collect_list(said("t", r))).alias("x")).select(F.struct(kind("x-mitre-matrix"), F.lit("m").alias("id"), F.reverse("x").alias("tactic_refs"))),
        supplier.select(F.struct(kind("attack-pattern"), said("p", s).alias("id"), F.col("s_name").alias("name"), (s % 7 == 0).alias("revoked"), ref(said("T", s + 1000)).alias("external_references"), phase(F.col("r_name")).alias("kill_chain_phases"))),
        supplier.where(s % 3 == 0).select(F.struct(kind("attack-pattern"), said("q", s).alias("id"), said(F.col("s_name"), " sub").alias("name"), (s % 5 == 0).alias("x_mitre_deprecated"), F.lit(True).alias("x_mitre_is_subtechnique"),
            ref(said("T", s + 1000, ".001")).alias("external_references"), phase(F.col("r_name")).alias("kill_chain_phases"))),
        nation.select(F.struct(kind("course-of-action"), said("m", n).alias("id"), F.col("n_name").alias("name"), ref(said("M", n + 1000)).alias("external_references"))),
        nation.select(F.struct(kind("intrusion-set"), said("g", n).alias("id"), F.col("n_name").alias("name"), ref(said("G", n + 1000)).alias("external_references"))),
        supplier.select(F.struct(kind("relationship"), said("r", s).alias("id"), F.lit("mitigates").alias("relationship_type"), said("m", n).alias("source_ref"), said("p", s).alias("target_ref"))),
        supplier.select(F.struct(kind("relationship"), said("u", s).alias("id"), F.lit("uses").alias("relationship_type"), said("g", n).alias("source_ref"), said("q", s).alias("target_ref"))),
    ]
    out = None
    for p in parts:
        one = p.toDF("x").select(F.from_json(F.to_json("x"), K.OBJECT).alias("o")).select("o.*")
        out = one if out is None else out.unionByName(one)
    return out


#: Live techniques of the made bundle, with their tactic.
_KB = """WITH s AS (SELECT s_suppkey AS s, s_name AS name, n_nationkey AS n, r_regionkey AS r, r_name AS region, CASE WHEN r_regionkey > 0 THEN (SELECT max(r_regionkey) FROM region) - r_regionkey ELSE 999 END AS sort_order
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT *, 'T' || (s + 1000) AS technique_id, false AS sub FROM s WHERE s % 7 <> 0 UNION ALL SELECT * REPLACE (name || ' sub' AS name), 'T' || (s + 1000) || '.001', true FROM s WHERE s % 3 = 0 AND s % 5 <> 0)
"""


@query("kb_matrix", _KB + "SELECT CAST(sort_order AS INTEGER) AS sort_order, 'TA000' || r AS tactic_id, region AS tactic_name, technique_id, name AS technique_name, CASE WHEN s % 3 = 0 AND s % 5 <> 0 THEN 1 ELSE 0 END AS sub_count FROM t WHERE NOT sub")
def kb_matrix(spark, sf_dir):
    return K.matrix(K.build(table_bundle(spark, sf_dir)))


@query("kb_tactics", "SELECT CAST(CASE WHEN r_regionkey > 0 THEN (SELECT max(r_regionkey) FROM region) - r_regionkey ELSE 999 END AS INTEGER) AS sort_order, 'TA000' || r_regionkey AS tactic_id FROM region")
def kb_tactics(spark, sf_dir):
    return K.list_tactics(K.build(table_bundle(spark, sf_dir))).select("sort_order", "tactic_id")


@query("kb_search", _KB + "SELECT technique_id, name FROM t WHERE region = 'ASIA' AND (name ILIKE '%0000000%' OR technique_id ILIKE '%0000000%') ORDER BY technique_id LIMIT 100")
def kb_search(spark, sf_dir):
    return K.page(K.search(K.build(table_bundle(spark, sf_dir)), "asia", "0000000")).select("technique_id", "name")


@query("kb_technique_card", _KB + """SELECT t.technique_id, t.name, t.technique_id[:5] AS parent_id, 'TA000' || t.r AS tactics, '' AS mitigations, 'G' || (t.n + 1000) AS procedures FROM t WHERE t.technique_id = 'T1003.001'
UNION ALL SELECT t.technique_id, t.name, NULL, 'TA000' || t.r, 'M' || (t.n + 1000), '' FROM t WHERE t.technique_id = 'T1003'""")
def kb_technique_card(spark, sf_dir):
    kb = K.build(table_bundle(spark, sf_dir))
    both = K.technique_card(kb, "t1003.001").unionByName(K.technique_card(kb, "T1003"))
    return both.select("technique_id", "name", "parent_id", *[F.coalesce(F.array_join(F.col(f"{c}.{k}"), ","), F.lit("")).alias(c) for c, k in (("tactics", "tactic_id"), ("mitigations", "mitigation_id"), ("procedures", "source_id"))])


@query("stix_relations", _KB + "SELECT 'mitigates' AS kind, 'M' || (n + 1000) AS source, technique_id FROM t WHERE NOT sub UNION ALL SELECT 'uses', 'G' || (n + 1000), technique_id FROM t WHERE sub")
def stix_relations(spark, sf_dir):
    kb = K.build(table_bundle(spark, sf_dir))
    rows = [("mitigates", "mitre_technique_mitigation", "mitigation_id"), ("detects", "mitre_detection_strategy", "strategy_id"), ("uses", "mitre_procedure", "source_id")]
    a, b, c = (kb[t].select(F.lit(kind).alias("kind"), F.col(key).alias("source"), "technique_id") for kind, t, key in rows)
    return a.unionByName(b).unionByName(c)


@query("kb_counts", _KB + """SELECT 'technique_count' AS key, CAST(count(*) AS VARCHAR) AS value FROM t UNION ALL SELECT 'tactic_count', CAST(count(*) AS VARCHAR) FROM region
UNION ALL SELECT 'mitigation_count', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT 'technique_tactic_count', CAST(count(*) AS VARCHAR) FROM t""")
def kb_counts(spark, sf_dir):
    kept = ("technique_count", "tactic_count", "mitigation_count", "technique_tactic_count")
    return K.build(table_bundle(spark, sf_dir))["mitre_meta"].where(F.col("key").isin(*kept))


@query("kb_enrich", EV.rstrip() + """, g AS (SELECT event_id, list_filter([CASE WHEN k % 2 = 0 THEN 'T1059.001' ELSE 'T9999' END, CASE WHEN flag THEN 'T1078' END, CASE WHEN code = 4625 THEN 'T1059' END], lambda x: x IS NOT NULL) AS ids FROM ev),
p AS (SELECT event_id, unnest(range(len(ids))) AS i, unnest(ids) AS t FROM g), kt(technique_id, name, tactics) AS (VALUES ('T1059', 'Shell', 'TA0002'), ('T1059.001', 'PowerShell', 'TA0002'), ('T1078', 'Accounts', 'TA0002,TA0001'))
SELECT event_id, CAST(i AS INTEGER) AS pos, t AS technique_id, kt.name, coalesce(kt.tactics, '') AS tactics, kt.name IS NOT NULL AS matched FROM p LEFT JOIN kt ON p.t = kt.technique_id""")
def kb_enrich(spark, sf_dir):
    """Tags that depend on the event: technique tags in either form, unknown ones, and others."""
    r = F.col("raw")
    k, flag = J.text(r, "k").cast("long"), J.text(r, "Flag") == "1"
    tags = F.array(F.when(k % 2 == 0, "attack.t1059.001").otherwise("ATTACK.T9999"), F.lit("attack.execution"), F.when(flag, "t1078").otherwise("cve.2024"), F.when(F.col("event_code") == "4625", "Attack.T1059").otherwise(""))
    rows = promoted(spark, sf_dir).select("event_id", tags.alias("tags"))
    return K.enrich(rows, K.build(bundle(spark)), "event_id").withColumn("tactics", F.array_join("tactics", ","))


# Sources, sinks and streaming: the events go through files and come back

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _read_back(spark, path: str, kind: str) -> DataFrame:
    e = E.promote(R.read_events(spark, path, kind, "files"))
    r = F.col("raw")
    return e.select(J.text(r, "id").alias("event_id"), "user_name", J.text(r, "EventType").alias("event_type"), "source_batch")


_FILES = EV + "SELECT event_id, user_name, event_type, 'files' AS source_batch FROM ev"


def _flat(spark, sf_dir) -> DataFrame:
    r = F.col("raw")
    return raw_events(spark, sf_dir).select(F.col("event_id").alias("id"), J.text(r, "TargetUserName").alias("TargetUserName"), J.text(r, "EventType").alias("EventType"))


@query("source_ndjson", _FILES)
def source_ndjson(spark, sf_dir):
    path = _folder(spark, "ndjson")
    _flat(spark, sf_dir).write.json(path)
    return _read_back(spark, path, "json")


@query("source_bad_lines", EV + "SELECT event_id, CAST(event_id AS BIGINT) % 5 < 2 AS malformed FROM ev")
def source_bad_lines(spark, sf_dir):
    """Lines of which some open an array that isn't one, and some are cut off: all of them come back."""
    path, i = _folder(spark, "bad_lines"), F.col("id").cast("long") % 5
    line = F.to_json(F.struct("id", "EventType"))
    line = F.when(i == 0, F.concat(F.lit('[2024-01-01] "id":"'), F.col("id"), F.lit('" plain line'))).when(i == 1, F.concat(F.lit("["), F.expr("substring(to_json(struct(id, EventType)), 1, length(id) + 9)"))).otherwise(line)
    _flat(spark, sf_dir).select(line.alias("value")).write.text(path)
    e = R.read_events(spark, path, "json", "files")
    return e.select(F.regexp_extract("raw", '"id":"([0-9]+)"', 1).alias("event_id"), R.malformed(F.col("raw")).alias("malformed"))


@query("source_csv", _FILES)
def source_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    _flat(spark, sf_dir).write.option("header", True).csv(path)
    return _read_back(spark, path, "csv")


@query("source_xml", _FILES)
def source_xml(spark, sf_dir):
    path = _folder(spark, "xml")
    _flat(spark, sf_dir).write.format("xml").option("rowTag", "Event").option("rootTag", "Events").save(path)
    return _read_back(spark, path, "xml")


@query("source_auditd", EV + "SELECT event_id, CAST(event_type AS VARCHAR) AS event_type, strftime(to_timestamp(1704067200 + CAST(event_id AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS event_time FROM ev")
def source_auditd(spark, sf_dir):
    path = _folder(spark, "auditd")
    line = F.concat(F.lit("type=SYSCALL msg=audit("), (F.col("id").cast("long") + 1704067200).cast("string"), F.lit(".250:7): id="), F.col("id"), F.lit(' EventType="'), F.col("EventType"), F.lit('"'))
    _flat(spark, sf_dir).select(line.alias("value")).write.text(path)
    e = E.promote(R.read_events(spark, path, "auditd", "files"))
    return e.select(J.text(F.col("raw"), "id").alias("event_id"), J.text(F.col("raw"), "EventType").alias("event_type"), "event_time")


@query("source_json_arrays", "SELECT 'region' AS source_batch, r_name AS name FROM region UNION ALL SELECT 'region', n_name FROM nation")
def source_json_arrays(spark, sf_dir):
    """One file that is an array over several lines, one on a single line, and the readers' choice between them."""
    path = _folder(spark, "arrays")
    for name, key, many in (("region", "r_name", True), ("nation", "n_name", False)):
        rows = [{"name": r[0]} for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key).collect()]
        spark.createDataFrame([(json.dumps(rows, indent=1 if many else None),)], "value string").coalesce(1).write.mode("append").text(path)
    return R.read_events(spark, path, "json", "region").select("source_batch", F.get_json_object("raw", "$.name").alias("name"))


@query("request_bodies", "SELECT n_name AS name, 'api' AS source_batch FROM nation")
def request_bodies(spark, sf_dir):
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").collect()]
    half = len(names) // 2
    rows = R.parse_body(json.dumps([{"name": n} for n in names[:half]])) + R.parse_body("\n\n".join(json.dumps({"name": n}) for n in names[half:]))
    return R.from_dicts(spark, rows, "api").select(F.get_json_object("raw", "$.name").alias("name"), "source_batch")


@query("events_appended", EV + "SELECT source_batch, 2 * count(*) AS n FROM ev GROUP BY 1")
def events_appended(spark, sf_dir):
    path = _folder(spark, "appended")
    for _ in range(2):
        append_events(raw_events(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("source_batch").cast("string").alias("source_batch")).agg(F.count("*").alias("n"))


def streamed(spark: SparkSession, sf_dir: str) -> Pipeline:
    """The events' texts as three parts that a stream takes in one by one; once for a session and folder. A part is as many files as tasks make its texts, so that none writes, or reads, all of it."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{hashlib.md5(sf_dir.encode(), usedforsecurity=False).hexdigest()}"
    burst = rule("event_count", ("Failed logon",), DAY * 3, {"gte": 2}, title="Burst")
    p = Pipeline(spark, f"{path}/live", pack, lambda: [burst])
    if exists(spark, f"{path}/done"):
        return p
    # One part after the other, each as one micro-batch, so that they are read in the order of their events.
    every, bounds = made_events(spark, sf_dir), ("2024-01-10", "2024-01-20", "9999")
    for low, high in zip(("", *bounds), bounds, strict=False):
        part = every.where((F.col("ingested_at") >= low) & (F.col("ingested_at") < high))
        part.select(F.col("raw").alias("value")).write.mode("append").option("compression", "gzip").text(f"{path}/in")
        stream = R.stream_events(spark, f"{path}/in", max_files=1_000_000).withColumn("source_batch", F.lit("s"))
        p.start(stream, f"{path}/checkpoint", None).awaitTermination()
    spark.range(1).write.parquet(f"{path}/done")
    return p


@query("stream_event_count", EV + "SELECT 's' AS source_batch, code AS event_code, count(*) AS n FROM (SELECT CAST(code AS VARCHAR) AS code FROM ev) GROUP BY 2")
def stream_event_count(spark, sf_dir):
    return streamed(spark, sf_dir).events().groupBy("source_batch", "event_code").agg(F.count("*").alias("n"))


@query("stream_alerts", EV + f""", f AS (SELECT user_name, ts, count(*) OVER (PARTITION BY user_name ORDER BY ts RANGE BETWEEN INTERVAL {DAY * 3} SECONDS PRECEDING AND CURRENT ROW) AS n FROM hit WHERE title = 'Failed logon')
SELECT title AS rule_title, host, CAST(count(*) AS BIGINT) AS event_count FROM hit WHERE title <> 'Busy host' GROUP BY 1, 2
UNION ALL SELECT 'Burst', user_name, CAST(arg_max(n, ts) AS BIGINT) FROM f WHERE n >= 2 GROUP BY 2""")
def stream_alerts(spark, sf_dir):
    """Alerts of three micro-batches: counts of rules add up, a correlation's count is that of its latest window. A rule's alerts are summed by host, as a batch with another first user has an alert of its own."""
    a = streamed(spark, sf_dir).alerts.read()
    user = F.when(F.col("engine") == "correlation", F.col("entities.users")[0]).otherwise(F.col("host"))
    return a.groupBy("rule_title", user.alias("host")).agg(F.sum("event_count").alias("event_count"))
