"""Feed states that stay small: streaming state with timers and expiry, for polls that arrive late and in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.proxy import Model
from ..plans.registry import query

#: What the state store must be: the one that keeps several states of a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "feed_url string, error_count long, total long, last_success timestamp, last_fetch timestamp, expired boolean"


class FeedStates(StatefulProcessor):
    """The status of one feed over its polls (ts, success).

    Polls count by second: of one second a success comes last, so its failures don't count.  Seconds that the
    watermark hasn't passed are open and kept one by one (failures, success); a timer at the end of each settles
    it, in order, into one value.  So a feed's state is that value and at most one entry for each second of the
    watermark's delay, however many polls there are.  A feed without polls for ``forget`` seconds of event time
    is expired by a timer and its state removed; a poll after that begins anew.
    """

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "failures long, total long, last_success long, last_fetch long")
        self.open = handle.getMapState("open", "second long", "failures long, success boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures, total, good, newest = self.settled.get() if self.settled.exists() else (0, 0, -1, -1)
        touched: dict[int, tuple[int, bool]] = {}
        for batch in rows:
            seconds = batch["ts"].astype("datetime64[s]").astype("int64")
            for second, part in batch.groupby(seconds)["success"]:
                wrong, right = touched.get(second, (0, False))
                touched[int(second)] = (wrong + int((~part).sum()), right or bool(part.any()))
            total += len(batch)
        watermark = timerValues.getCurrentWatermarkInMs() // 1000
        for second, (wrong, right) in touched.items():
            before = self.open.getValue((second,)) if self.open.containsKey((second,)) else None
            if before is None:
                # The first batch has no watermark yet, and one that is past can't fire again.
                self.handle.registerTimer(max(second + 1, watermark + 1) * 1000)
            self.open.updateValue((second,), (wrong + before[0], right or before[1]) if before else (wrong, right))
        last = max(newest, *touched)
        if last > newest:
            if newest >= 0:
                self.handle.deleteTimer((newest + self.forget) * 1000 + 1)
            self.handle.registerTimer((last + self.forget) * 1000 + 1)  # an odd millisecond: never that of a second's end
        self.settled.update((failures, total, good, last))
        yield self._row(key, failures, total, good, last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.settled.exists():
            return
        failures, total, good, newest = self.settled.get()
        if at % 1000:
            yield self._row(key, failures, total, good, newest, True)
            self.settled.clear()
            self.open.clear()
            return
        past = sorted((k[0], *v) for k, v in self.open.iterator() if k[0] < at // 1000)
        for second, wrong, right in past:
            failures, good = (0, second) if right else (failures + wrong, good)
            self.open.removeKey((second,))
        if past:
            self.settled.update((failures, total, good, newest))

    def _row(self, key: tuple, failures: int, total: int, good: int, newest: int, expired: bool = False) -> pd.DataFrame:
        """The status with the open seconds counted in."""
        for second, wrong, right in sorted((k[0], *v) for k, v in self.open.iterator()):
            failures, good = (0, second) if right else (failures + wrong, good)
        time = lambda s: pd.to_datetime([s if s >= 0 else None], unit="s")
        return pd.DataFrame({"feed_url": [key[0]], "error_count": [failures], "total": [total], "last_success": time(good), "last_fetch": time(newest), "expired": [expired]})

    def close(self) -> None:
        pass


def feed_states(stream: DataFrame, late: str = "10 minutes", forget: int = 30 * 86400) -> DataFrame:
    """The status of each feed over a stream of polls (feed_url, ts, success), a row for each feed and trigger; polls later than ``late`` are dropped.

    The session must name PROVIDER in spark.sql.streaming.stateStore.providerClass.
    """
    provider = stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if provider != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    polls = stream.withWatermark("ts", late).groupBy("feed_url")
    return polls.transformWithStateInPandas(FeedStates(forget), STATE, "Update", "EventTime")


def feed_status(polls: DataFrame) -> DataFrame:
    """The batch form: feed_url, error_count, total, last_success and last_fetch, by two aggregates.

    Failures are summed by second first, so that what is compared with the last success is as many rows as a feed has seconds.
    """
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    seconds = polls.groupBy("feed_url", second.alias("second")).agg(F.count_if(~F.col("success")).alias("failures"), F.bool_or("success").alias("ok"), F.count(F.lit(1)).alias("n"))
    last = seconds.groupBy("feed_url").agg(F.max(F.when(F.col("ok"), F.col("second"))).alias("good"), F.max("second").alias("newest"), F.sum("n").alias("total"))
    after = seconds.join(last.select("feed_url", "good"), "feed_url").where("good IS NULL OR second > good").groupBy("feed_url").agg(F.sum("failures").alias("error_count"))
    found = last.join(after, "feed_url", "left")
    return found.select("feed_url", F.coalesce("error_count", F.lit(0)).alias("error_count"), "total", F.timestamp_seconds("good").alias("last_success"), F.timestamp_seconds("newest").alias("last_fetch"))


@query("r02b_feed_status", """WITH g AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type <> 'error' AS ok FROM events),
l AS (SELECT user_id, max(s) FILTER (WHERE ok) AS good, max(s) AS newest, count(*) AS total FROM g GROUP BY 1)
SELECT 'user-' || l.user_id AS feed_url, count(g.s) AS error_count, any_value(total) AS total, any_value(good) AS good, any_value(newest) AS newest
FROM l LEFT JOIN g ON g.user_id = l.user_id AND NOT g.ok AND (l.good IS NULL OR g.s > l.good) GROUP BY 1""")
def r02b(m: Model) -> DataFrame:
    polls = m.table("events").selectExpr("concat('user-', user_id) AS feed_url", "ts", "event_type <> 'error' AS success")
    found = feed_status(polls)
    return found.select("feed_url", "error_count", "total", F.unix_seconds("last_success").alias("good"), F.unix_seconds("last_fetch").alias("newest"))
