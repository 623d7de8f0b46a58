"""Correlations as a stream with state of its own: each rule and key keeps its hits within reach.

The counterpart of the ledger mode for streams that want no tables: hits go
to transformWithState under their rule, source and key; what it holds is put
away by event-time timers when the watermark has passed it. A late hit, up to
the watermark's delay, fires the anchors whose windows it lies in, so what
fires is what the ledger mode fires, whatever the order of arrival.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import joint
from ..operators.joint import Rules
from ..plans.catalog import COUNT_OPS, Correlation

FIRED = "rule int, source_batch string, key string, event_id string, rule_title string, at_us bigint, n bigint"
HITS = "at_us bigint, event_id string, rule_title string, value string"
#: The state store that transformWithState takes.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TESTS = {"gte": lambda n, v: n >= v, "gt": lambda n, v: n > v, "lte": lambda n, v: n <= v, "lt": lambda n, v: n < v, "eq": lambda n, v: n == v, "neq": lambda n, v: n != v}


def anchors(hits: list[tuple], c: Correlation, fresh: set[tuple[str, str]]) -> Iterator[tuple[int, str, str, int]]:
    """(time, event id, title, n) of the hits of one key at which c fires, of those that are fresh or whose windows a fresh one lies in. hits: (time, event id, title, value), sorted. One pass."""
    span, kind = c.timespan * 1_000_000, c.kind
    bounds = [(op, joint._number(c.condition.get(op))) for op in COUNT_OPS]
    bounds = [(op, v) for op, v in bounds if v is not None]
    counted = kind in ("event_count", "value_count") or any(k != "field" for k in c.condition)
    begun: list[int | None] = [None] * len(c.titles)
    seen: Counter = Counter()
    first = at = 0
    newest = None
    while at < len(hits):
        end = at
        time = hits[at][0]
        while end < len(hits) and hits[end][0] == time:
            end += 1
        group = []
        for h in hits[at:end]:
            before = list(begun)
            for k, title in enumerate(c.titles):
                since = time if k == 0 else before[k - 1]
                if title == h[2] and since is not None:
                    begun[k] = since if begun[k] is None else max(begun[k], since)
            group.append((h, begun[-1]))
            seen[h[2] if kind.startswith("temporal") else h[3] if kind == "value_count" else ""] += 1
            if (h[1], h[2]) in fresh:
                newest = time
        while hits[first][0] < time - span:
            h = hits[first]
            key = h[2] if kind.startswith("temporal") else h[3] if kind == "value_count" else ""
            seen[key] -= 1
            if not seen[key]:
                del seen[key]
            first += 1
        n = end - first if kind == "event_count" else sum(k is not None for k in seen)
        fires = (bool(bounds) and all(_TESTS[op](n, v) for op, v in bounds)) if counted else n >= len(set(c.titles))
        if fires and newest is not None and time - newest <= span:
            for h, since in group:
                if kind != "temporal_ordered" or (since is not None and since >= time - span):
                    yield time, h[1], h[2], n
        at = end


class Correlator(StatefulProcessor):
    """The state of one rule and key: its hits within reach of the watermark."""

    def __init__(self, correlations: list[Correlation]) -> None:
        self.correlations = correlations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", HITS)

    def _kept(self, span: int, watermark_ms: int) -> list[tuple]:
        return [h for h in (self.hits.get() if self.hits.exists() else ()) if h[0] >= watermark_ms * 1000 - span]

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        c = self.correlations[int(key[0])]
        span, watermark = c.timespan * 1_000_000, timerValues.getCurrentWatermarkInMs()
        held = self._kept(span, watermark)
        known = {(h[1], h[2]) for h in held}
        new = {(e, t): (int(at), e, t, v) for pdf in rows for at, e, t, v in zip(pdf["at_us"], pdf["event_id"], pdf["rule_title"], pdf["value"].astype("object").where(pdf["value"].notna(), None), strict=True) if (e, t) not in known}
        hits = sorted([*held, *new.values()], key=lambda h: h[:3])
        self.hits.put(hits)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(watermark, (hits[-1][0] + span) // 1000) + 1)
        out = [(key[0], key[1], key[2], e, t, at, n) for at, e, t, n in anchors(hits, c, set(new))]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FIRED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        span = self.correlations[int(key[0])].timespan * 1_000_000
        held = self._kept(span, timerValues.getCurrentWatermarkInMs())
        if held:
            self.hits.put(held)
            self.handle.registerTimer((held[-1][0] + span) // 1000 + 1)
        else:
            self.hits.clear()
        yield pd.DataFrame([], columns=[x.split()[0] for x in FIRED.split(", ")])

    def close(self) -> None:
        pass


def correlate_stream(hits: DataFrame, correlations: list[Correlation], delay: str = "1 hour") -> DataFrame:
    """What fires in a stream of ledger rows: rule (its place), correlation, event_id, rule_title, source_batch, event_ts, n and keys. An anchor whose count a late hit changes comes again.

    Hits that are later than delay behind the latest are dropped. Rules over
    other correlations take the output as another stream's hits. The session
    must have ROCKS as its spark.sql.streaming.stateStore.providerClass.
    """
    if any(kind == "correlation" for c in correlations for _, kind in c.base_rules):
        raise ValueError("a rule over correlations needs a stream of their hits")
    rules = Rules(correlations)
    spark = hits.sparkSession
    table = rules.rule_table(spark).withColumnRenamed("g", "g_")
    rows = joint._streams(hits, rules).join(F.broadcast(table), (F.col("g") == F.col("g_")) & (F.col("rule_title") == F.col("title_")))
    value = F.when(F.col("counts") == "values", F.try_element_at("group_values", F.col("field")))
    rows = rows.select("rule", "source_batch", F.to_json("keys").alias("key"), "at_us", "event_id", "rule_title", value.alias("value"), F.col("event_ts").cast("timestamp").alias("event_at"))
    states = rows.withWatermark("event_at", delay).groupBy("rule", "source_batch", "key")
    fired = states.transformWithStateInPandas(Correlator(correlations), FIRED, "append", "eventTime")
    return fired.select("rule", rules.head(F.col("rule"))["title"].alias("correlation"), "event_id", "rule_title", "source_batch", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("event_ts"), "n", F.from_json("key", "array<string>").alias("keys"))
