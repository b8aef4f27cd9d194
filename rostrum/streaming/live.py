"""Streaming forms: comments as they come, usage by the hour, and the calls of the last hour."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def new_comments(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each comment once, although a listing that is re-anchored by time shows ids again."""
    return stream.withWatermark("received_date", delay).dropDuplicatesWithinWatermark(["comment_id"])


def hourly_usage(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """service, hour, calls, throttled, tokens, in hourly windows; late calls within the delay still count."""
    w = calls.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "service").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == 429).alias("throttled"), F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens")
    )
    return w.select("service", F.col("window.start").alias("hour"), "calls", "throttled", "tokens")


HOUR = 3600


class RollingHour(StatefulProcessor):
    """One service's calls of the last hour, as counts by second: at most HOUR + 1 of them, whatever comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "second long", "n long")
        self.last = handle.getValueState("last", "second long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: Counter[int] = Counter()
        for part in rows:
            new.update((part["ts"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist())
        before = self.last.get()[0] if self.last.exists() else None
        last = max(new) if before is None else max(before, *new)
        for second, n in new.items():
            if second >= last - HOUR:
                had = self.counts.getValue((second,))[0] if self.counts.containsKey((second,)) else 0
                self.counts.updateValue((second,), (had + n,))
        # dropped first: what is left counts
        for (second,) in [k for k in self.counts.keys() if k[0] < last - HOUR]:
            self.counts.removeKey((second,))
        if last != before:
            self.last.update((last,))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer((last + HOUR + 1) * 1000)
        used = sum(n for (n,) in self.counts.values())
        yield pd.DataFrame({"service": [key[0]], "ts": [pd.Timestamp(last, unit="s")], "used": [used]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.counts.clear()
        self.last.clear()
        yield pd.DataFrame({"service": [key[0]], "ts": [pd.Timestamp(at, unit="ms")], "used": [0]})

    def close(self) -> None:
        pass


def rolling_quota(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """service, ts, used: after each micro-batch, of the services that had calls, the last call's second and the calls of the hour up to it; and
    0 once an hour has passed without one. Late calls of that hour count, older ones are outside it.

    The session needs a state store that keeps maps (`spark.sql.streaming.stateStore.providerClass`: RocksDBStateStoreProvider).
    """
    timed = calls.where("ts is not null").select("service", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("service").transformWithStateInPandas(RollingHour(), "service string, ts timestamp, used long", "Update", "EventTime")
