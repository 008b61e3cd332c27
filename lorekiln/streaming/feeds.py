"""Feed polling as Structured Streaming: deduplicated ingest, feed states, budgeted queues, windows over events."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.proxy import Model, over
from ..plans.registry import query
from ..plans.shared import materialize
from ..sources.tables import insert_missing, merged, write_replacing

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def article_stream(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """At-least-once arrivals made unique by key; keys older than the watermark are forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


#: Partitions of a stored table: a micro-batch reads and replaces only those that its keys fall in.
STORE_PARTS = 64


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str, policy: dict[str, str] | None = None, order: str | None = None, parts: int = STORE_PARTS) -> StreamingQuery:
    """Every micro-batch is upserted into the Parquet table at ``path``; a repeated batch changes nothing.

    ``policy`` says for each further column what a conflict keeps (see ``merged``; by default the new value), ``order``
    which of a batch's rows of one key is the latest (by default any).  The table is partitioned by a hash of the key;
    only partitions with keys of the batch are read, merged and replaced, and a replaced partition is first written
    beside the table, since it is read from there.  The table is plain Parquet, so a driver that dies while partitions
    are replaced leaves some of them new; the batch then runs again.  ``snapshots.upsert_stream`` shows a batch whole
    or not at all.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    rest = [c for c in stream.columns if c not in keys]
    rules = policy or {c: "new" for c in rest}

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if order:
            latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
            unique = batch.withColumn("_latest", latest).where("_latest = 1").drop("_latest")
        else:
            unique = batch.dropDuplicates(keys)
        new = materialize(unique.select(*keys, *rest).withColumn("_part", part), "batch")
        if _there(spark, path):
            touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # at most ``parts`` numbers
            held = spark.read.parquet(path).where(F.col("_part").isin(touched)).select(*keys, *rest)
            new = materialize(merged(held, new.drop("_part"), keys, rules).withColumn("_part", part), "batch")
        write_replacing(new, path, "_part")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATUS = "feed_url string, error_count long, total long"


def feed_states(stream: DataFrame) -> DataFrame:
    """State of each feed over (feed_url, event_id, success): the failures after its latest success, and all events.

    Events may come in any order: the state holds the latest success and the failures after it, so that neither
    the batches of a trigger nor their rows need be sorted.  That list grows while a feed fails; where events have
    a time, ``states.feed_states`` keeps a state of bounded size.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, failures, total = state.get if state.exists else (-1, [], 0)
        failures = list(failures)
        for b in batches:
            total += len(b)
            good = b.loc[b["success"], "event_id"]
            last = max([last, *good.tolist()])
            failures = [i for i in failures + b.loc[~b["success"], "event_id"].tolist() if i > last]
        state.update((int(last), failures, int(total)))
        yield pd.DataFrame({"feed_url": [key[0]], "error_count": [len(failures)], "total": [total]})

    return stream.groupBy("feed_url").applyInPandasWithState(update, STATUS, "last_ok long, failures array<long>, total long", "update", GroupStateTimeout.NoTimeout)


def trailing_failures(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The batch form: failures after each key's last success, by aggregates alone."""
    last = F.max(F.when(F.col("success"), F.col(order)))
    latest = events.groupBy(*keys).agg(last.alias("last_ok"), F.count(F.lit(1)).alias("total"))
    after = events.join(latest.select(*keys, "last_ok"), keys).where((F.col("last_ok").isNull()) | (F.col(order) > F.col("last_ok")))
    failed = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("error_count"))
    return latest.join(failed, keys, "left").select(*keys, F.coalesce("error_count", F.lit(0)).alias("error_count"), "total")


@query("r02_feed_states", "WITH e AS (SELECT user_id AS feed_url, event_id, event_type <> 'error' AS ok FROM events), l AS (SELECT feed_url, max(event_id) FILTER (WHERE ok) AS last_ok, count(*) AS total FROM e GROUP BY 1) SELECT l.feed_url, total, count(e.event_id) AS error_count FROM l LEFT JOIN e ON e.feed_url = l.feed_url AND (last_ok IS NULL OR e.event_id > last_ok) GROUP BY 1, 2")
def r02(m: Model) -> DataFrame:
    events = m.table("events").selectExpr("user_id AS feed_url", "event_id", "event_type <> 'error' AS success")
    return trailing_failures(events, ["feed_url"], "event_id")


#: Buckets that a key's queue is cut into by its order.
QUEUE_BUCKETS = 256


def within_budget(queue: DataFrame, cap: float, order: str, key: str, buckets: int = QUEUE_BUCKETS) -> DataFrame:
    """Whether each queued item still fits under the cap of its key's running cost, in order of the numeric column ``order``.

    Sums of buckets of that order come first, then running sums within a bucket: no task sees all items of a key.
    """
    ends = queue.groupBy(key).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    width = F.greatest((F.col("_high") - F.col("_low") + 1) / buckets, F.lit(1.0))
    placed = queue.join(ends, key).withColumn("_bucket", F.floor((F.col(order) - F.col("_low")) / width)).drop("_low", "_high")
    sums = placed.groupBy(key, "_bucket").agg(F.sum("cost").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(key, "_bucket", F.coalesce(before, F.lit(0.0)).alias("_before"))
    inner = F.sum("cost").over(Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    running = placed.join(starts, [key, "_bucket"]).withColumn("claimed", F.col("_before") + inner <= cap)
    return running.select(*queue.columns, "claimed")


@query("r03_budgeted_queue", over("costs", "SELECT api_provider, count(*) FILTER (WHERE run <= 1000000) AS claimed, count(*) FILTER (WHERE run > 1000000) AS skipped FROM (SELECT api_provider, sum(round(cost)) OVER (PARTITION BY api_provider ORDER BY article_id) AS run FROM costs) GROUP BY 1"))
def r03(m: Model) -> DataFrame:
    queue = within_budget(m.costs.withColumn("cost", F.round("cost")), 1_000_000, "article_id", "api_provider")
    return queue.groupBy("api_provider").agg(F.count_if("claimed").alias("claimed"), F.count_if(~F.col("claimed")).alias("skipped"))


@query("r01_deduplicated_batch", over("articles", "SELECT source, count(DISTINCT url) AS articles FROM articles GROUP BY source"))
def r01(m: Model) -> DataFrame:
    seen = m.articles.where("id % 2 = 0")
    return insert_missing(seen, m.articles, ["url"]).groupBy("source").agg(F.count(F.lit(1)).alias("articles"))


def windowed_counts(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Tumbling windows by event type; the same plan serves a watermarked stream."""
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("r05_event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r05(m: Model) -> DataFrame:
    return windowed_counts(m.table("events")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


class Provider:
    """What calls an outside service for rows: ``fetch`` maps one input to one output; offline, a deterministic stand-in."""

    def fetch(self, value: str | None) -> str | None:
        return None if value is None else f"offline:{len(value)}"


class RateLimited(Exception):
    """Raised by a provider whose service asks to wait."""


class Patient(Provider):
    """A provider that is asked again after 5, 10 and 20 seconds where its service asks to wait, with a pause after each call; then null."""

    def __init__(self, inner: Provider, attempts: int = 3, first_wait: float = 5.0, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.attempts, self.first_wait, self.pause, self.sleep = inner, attempts, first_wait, pause, sleep

    def fetch(self, value: str | None) -> str | None:
        for k in range(self.attempts + 1):
            try:
                answer = self.inner.fetch(value)
            except RateLimited:
                if k == self.attempts:
                    return None
                self.sleep(self.first_wait * 2**k)
                continue
            if self.pause:
                self.sleep(self.pause)
            return answer
        return None


def through(df: DataFrame, column: str, result: str, make: Callable[[], Provider] = Provider) -> DataFrame:
    """``df`` with a provider's answers; one provider serves a partition."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{result}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            yield b.assign(**{result: [provider.fetch(v) for v in b[column]]})

    return df.mapInPandas(run, schema)


@query("k03_provider", "SELECT page_id, url, 'offline:' || length(url) AS answer FROM pages")
def k03(m: Model) -> DataFrame:
    return through(m.table("pages").select("page_id", "url"), "url", "answer")
