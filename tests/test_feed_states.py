"""The feed state with timers: equals its batch form, whatever the order of arrival; stays small; expires; survives a restart."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekiln.streaming import states

POLL = "feed_url string, ts timestamp, success boolean"
START = datetime(2001, 8, 1)


@pytest.fixture(autouse=True)
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, states.PROVIDER)
    yield
    spark.conf.set(key, before)


def put(spark, path, polls, at):
    """A file of polls (feed, seconds after the start, success)."""
    rows = [(f, START + timedelta(seconds=s), ok) for f, s, ok in polls]
    spark.createDataFrame(rows, POLL).coalesce(1).write.mode("append").parquet(f"{path}/{at:03}")


def run(spark, path, check, **kw):
    stream = spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    rows: list[dict] = []
    sink = states.feed_states(stream, **kw).writeStream.foreachBatch(lambda b, _: rows.extend(r.asDict() for r in b.collect()))
    q = sink.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, rows


def latest(rows):
    out = {}
    for r in rows:
        if not r["expired"] and (r["feed_url"] not in out or r["total"] >= out[r["feed_url"]]["total"]):
            out[r["feed_url"]] = r
    return {(r["feed_url"], r["error_count"], r["total"], r["last_success"], r["last_fetch"]) for r in out.values()}


def batch(spark, path):
    read = spark.read.schema(POLL).option("recursiveFileLookup", True).parquet(path)
    return {tuple(r) for r in states.feed_status(read).collect()}


def test_any_order_within_the_delay_and_a_restart(spark, tmp_path):
    rng, path, check = random.Random(5), str(tmp_path / "polls"), str(tmp_path / "check")
    polls = [(f"f{rng.randrange(4)}", s // 2, rng.random() < 0.2) for s in range(600)]
    for k in range(0, 300, 60):  # shuffled within a file, and two files overlap in time
        some = polls[k : k + 90 if k < 240 else 300]
        rng.shuffle(some)
        put(spark, path, some, k)
    _, rows = run(spark, path, check, late="60 seconds")
    assert latest(rows) == batch(spark, path)
    some = polls[300:]
    rng.shuffle(some)
    put(spark, path, some, 600)
    _, rows = run(spark, path, check, late="60 seconds")
    assert {r for r in latest(rows)} == {r for r in batch(spark, path) if r[0] in {x["feed_url"] for x in rows}}


def test_a_failing_feed_keeps_a_small_state(spark, tmp_path):
    """Forty thousand failures in eight files: the settled value, and the seconds of the delay."""
    path, check, each = str(tmp_path / "polls"), str(tmp_path / "check"), 5_000
    for k in range(8):
        ids = spark.range(k * each, (k + 1) * each)
        ts = F.timestamp_seconds(F.lit(int(START.timestamp())) + F.floor(F.col("id") / 100))
        ids.select(F.lit("dead").alias("feed_url"), ts.alias("ts"), F.lit(False).alias("success")).coalesce(1).write.parquet(f"{path}/{k:03}")
    q, rows = run(spark, path, check, late="20 seconds")
    assert max(r["error_count"] for r in rows) == 8 * each == max(r["total"] for r in rows)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(x.json) for x in q.recentProgress) if p["stateOperators"]]
    # One trigger's seconds (50) and the delay's at most, with a timer each, and no growth from the second trigger on.
    assert max(kept[2:]) <= max(kept[:3]) + 5 and kept[-1] < 2000


def test_silent_feeds_expire_and_begin_anew(spark, tmp_path):
    path, check = str(tmp_path / "polls"), str(tmp_path / "check")
    put(spark, path, [("quiet", 0, False), ("quiet", 1, False), ("loud", 0, True)], 0)
    put(spark, path, [("loud", 500, True)], 1)
    put(spark, path, [("loud", 520, False)], 2)
    put(spark, path, [("quiet", 530, False), ("loud", 530, False)], 3)
    _, rows = run(spark, path, check, late="5 seconds", forget=100)
    quiet = [(r["error_count"], r["total"], r["expired"]) for r in rows if r["feed_url"] == "quiet"]
    assert quiet == [(2, 2, False), (2, 2, True), (1, 1, False)]


def test_provider_is_asked_for(spark, tmp_path):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="providerClass"):
        states.feed_states(spark.readStream.schema(POLL).parquet(str(tmp_path)))
