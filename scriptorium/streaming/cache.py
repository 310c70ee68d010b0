"""Cache rows with a lifetime, as keyed state: puts, lookups, expiry and bounded state.

An entry lives for a span of event time from when it was put (or, if so wanted, last found).  Whether a lookup finds it is
told by the rows' own times, so results do not depend on how rows fall into batches; a timer at the entry's end takes it
out of the state once the watermark has passed it, so the state holds living entries only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.recency import as_of

OUTPUT = "key string, ts timestamp, hit boolean, value string"
#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class _Cache(StatefulProcessor):
    def __init__(self, lifetime_ms: int, refresh: bool):
        self.lifetime, self.refresh = lifetime_ms, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, until long")

    def _keep(self, value: str, now: int) -> tuple[str, int]:
        self.entry.update((value, now + self.lifetime))
        self.handle.registerTimer(now + self.lifetime)
        return value, now + self.lifetime

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame["ms"] = frame["ts"].astype("datetime64[ms]").astype("int64")
        # Of one time lookups come first, and the largest value put stands.
        frame = frame.assign(put=frame["value"].notna()).sort_values(["ms", "put", "value"])
        held = self.entry.get() if self.entry.exists() else None
        out = []
        for row in frame.itertuples():
            if row.put:
                held = self._keep(row.value, row.ms)
                continue
            hit = held is not None and row.ms < held[1]
            out.append((key[0], row.ts, hit, held[0] if hit else None))
            if hit and self.refresh:
                held = self._keep(held[0], row.ms)
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "value"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is open."""


def cached(rows: DataFrame, lifetime_ms: int, late: str = "10 minutes", refresh: bool = False) -> DataFrame:
    """key, ts, hit, value of every lookup among ``rows`` (key, ts, value: a put, or a lookup if null).

    A put is found from after its time on, and no longer at the very end of its lifetime.  Rows later than ``late`` are
    dropped.  A batch of puts and lookups gives the same rows by an as-of join, if nothing is refreshed.
    """
    if rows.isStreaming:
        state = with_state(rows.sparkSession)  # noqa: F841
        keyed = rows.select("key", "ts", "value").withWatermark("ts", late).groupBy("key")
        return keyed.transformWithStateInPandas(_Cache(lifetime_ms, refresh), OUTPUT, "Append", "EventTime")
    if refresh:
        raise ValueError("a batch knows no refreshing")
    found = as_of(rows.where("value is null").select("key", "ts"), rows.where("value is not null"), ["key"], "ts", ["value"])
    hit = F.coalesce((F.unix_millis("ts") - F.unix_millis("asof_ts")) < lifetime_ms, F.lit(False))
    return found.select("key", "ts", hit.alias("hit"), F.when(hit, F.col("asof_value")).alias("value"))
