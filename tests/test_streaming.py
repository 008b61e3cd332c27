from pyspark.sql import functions as F

from lorekiln.sources import tables
from lorekiln.streaming import feeds


def test_upsert_stream_keeps_keys_unique(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    rows = spark.createDataFrame([("u1", "a"), ("u1", "a"), ("u2", "b")], "url string, title string")
    rows.write.parquet(src)
    for _ in range(2):
        feeds.upsert_batches(feeds.article_stream(spark, src, "url string, title string"), out, ["url"], check).awaitTermination()
        rows.write.mode("append").parquet(src)
    assert spark.read.parquet(out).count() == 2


def test_feed_states_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [(1, "f", True), (2, "f", False), (3, "f", False), (4, "g", False), (5, "g", True)]
    spark.createDataFrame(rows, "event_id long, feed_url string, success boolean").write.parquet(src)
    stream = spark.readStream.schema("event_id long, feed_url string, success boolean").parquet(src)
    q = feeds.feed_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["feed_url"], r["error_count"]) for r in spark.table("states").collect()}
    batch = feeds.trailing_failures(spark.read.parquet(src), ["feed_url"], "event_id")
    assert got == {(r["feed_url"], r["error_count"]) for r in batch.collect()} == {("f", 2), ("g", 0)}


def test_feed_and_file_sources(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>http://x/1</link><description>D</description></item><item><title>no link</title></item></channel></rss>")
    got = tables.read_feed(spark, str(tmp_path / "feed.xml")).collect()
    assert [(r["title"], r["url"], r["content"]) for r in got] == [("T", "http://x/1", "D")]
    (tmp_path / "a.txt").write_text("hello\nworld")
    file = tables.read_text_files(spark, str(tmp_path)).first()
    assert (file["id"], file["is_html"], file["content"]) == ("a", False, "hello\nworld")
    tables.write_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    frame = spark.range(4).withColumn("kind", F.when(F.col("id") < 2, "a").otherwise("b"))
    tables.write_replacing(frame, str(tmp_path / "p"), "kind")
    tables.write_replacing(frame.where("kind = 'a'").limit(1), str(tmp_path / "p"), "kind")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
