"""Snapshot tables: failures between files and manifest, pinned readers, conflicts, replayed batches; the caches on them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekiln.sources.caches import LayoutCache, LookupCache
from lorekiln.sources.snapshots import Conflict, Snapshots, by_hash, upsert_stream
from lorekiln.streaming import feeds

SCHEMA = "url string, title string, n long"


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "store"), SCHEMA, by_hash(["url"], 8))


def rows(spark, names, title, n=0):
    return spark.createDataFrame([(u, title, n) for u in names], SCHEMA)


def held(table, **kw):
    return {(r["url"], r["title"]) for r in table.read(**kw).collect()}


NAMES = [f"u{k}" for k in range(40)]


def test_failure_before_the_manifest_leaves_the_old_state(spark, store, monkeypatch):
    assert held(store) == set() and store.versions() == []
    store.upsert(rows(spark, NAMES, "old"), ["url"])
    monkeypatch.setattr(store, "_publish", lambda manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # all new files are there, the manifest isn't
        store.upsert(rows(spark, NAMES, "new"), ["url"])
    monkeypatch.undo()
    assert held(store) == {(u, "old") for u in NAMES} and store.versions() == [1]
    store.upsert(rows(spark, NAMES[:5], "new"), ["url"])
    assert held(store) == {(u, "new" if u in NAMES[:5] else "old") for u in NAMES}


def test_failure_between_files_leaves_the_old_state(spark, store):
    """A task that fails when some partitions are written and others are not."""
    store.upsert(rows(spark, NAMES, "old"), ["url"])
    broken = rows(spark, NAMES, "new").repartition(8, "url").withColumn("title", F.when(F.col("url") == "u7", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        store.commit(broken)
    assert held(store) == {(u, "old") for u in NAMES} and store.versions() == [1]
    store.expire(keep=5)
    assert len(store._names("data")) == 1


def test_pinned_readers_and_expiry(spark, store):
    store.upsert(rows(spark, NAMES, "a"), ["url"])
    pinned = store.read()
    for title in "bcd":
        store.upsert(rows(spark, NAMES[:20], title), ["url"])
    assert {(r["url"], r["title"]) for r in pinned.collect()} == {(u, "a") for u in NAMES} == held(store, version=1)
    store.expire(keep=2)
    assert store.versions() == [3, 4] and held(store, version=3) == {(u, "c" if u in NAMES[:20] else "a") for u in NAMES}
    with pytest.raises(ValueError):
        store.read(version=1)


def test_two_writers_on_one_base(spark, store):
    base = store.manifest()
    store.commit(rows(spark, ["x"], "first"), base)
    with pytest.raises(Conflict):
        store.commit(rows(spark, ["x"], "second"), base)
    assert held(store) == {("x", "first")}


def test_policies_partitions_and_order(spark, store):
    store.upsert(rows(spark, ["a", "b"], "old", 5), ["url"])
    new = rows(spark, ["b"], "x", 7).unionByName(rows(spark, ["b"], "y", 9)).unionByName(rows(spark, ["c"], "z", 1))
    store.upsert(new, ["url"], {"title": "old", "n": "greatest"}, order="n")
    assert {tuple(r) for r in store.read().collect()} == {("a", "old", 5), ("b", "old", 9), ("c", "z", 1)}
    part = store.parts_of(rows(spark, ["a"], ""))
    assert ("a", "old") in held(store, parts=part) and len(part) == 1 and held(store, parts=["no such"]) == set()


def test_stream_of_upserts_and_replayed_batch(spark, tmp_path):
    src, path, check = (str(tmp_path / n) for n in ("src", "store", "check"))
    table = lambda s: Snapshots(s, path, SCHEMA, by_hash(["url"], 8))
    for title in ("a", "b"):
        rows(spark, NAMES[:10], title).write.mode("append").parquet(src)
        upsert_stream(feeds.article_stream(spark, src, SCHEMA), table, ["url"], check).awaitTermination()
    store = table(spark)
    assert held(store) == {(u, "b") for u in NAMES[:10]} and store.versions() == [1, 2]
    # The batch that was published last runs again: nothing changes.
    assert store.upsert(rows(spark, NAMES, "again"), ["url"], batch=(check, 1)) == 2 and held(store) == {(u, "b") for u in NAMES[:10]}


def test_stream_that_dies_before_its_manifest(spark, tmp_path, monkeypatch):
    src, path, check = (str(tmp_path / n) for n in ("src", "store", "check"))
    table = lambda s: Snapshots(s, path, SCHEMA, by_hash(["url"], 8))
    rows(spark, NAMES, "a").write.parquet(src)
    upsert_stream(feeds.article_stream(spark, src, SCHEMA), table, ["url"], check).awaitTermination()
    rows(spark, NAMES, "b").write.mode("append").parquet(src)
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_publish", lambda self, manifest: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            upsert_stream(feeds.article_stream(spark, src, SCHEMA), table, ["url"], check).awaitTermination()
    assert held(table(spark)) == {(u, "a") for u in NAMES}
    upsert_stream(feeds.article_stream(spark, src, SCHEMA), table, ["url"], check).awaitTermination()
    assert held(table(spark)) == {(u, "b") for u in NAMES} and table(spark).versions() == [1, 2]


def test_lookup_cache(spark, tmp_path):
    cache = LookupCache(spark, str(tmp_path / "c"), 4)
    now, schema = datetime(2001, 8, 1), "entity_name string, wikidata_id string, description string, properties string, cached_at timestamp_ntz"
    ask = lambda *names: cache.get(spark.createDataFrame([(n,) for n in names], "entity_name string"), now).collect()
    assert [r["wikidata_id"] for r in ask("A", None)] == [None, None] and tuple(cache.stats().first()) == (0, 0)
    cache.set(spark.createDataFrame([("Ada", "Q1", "d", "{}", datetime(2001, 7, 2)), ("ADA", "Q2", "e", "{}", datetime(2001, 7, 3)), ("Old", "Q3", None, None, datetime(2001, 7, 1)), (None, "Q4", "", "", now)], schema))
    assert {(r["entity_name"], r["wikidata_id"]) for r in ask("ada", "aDa", "old", None, "new")} == {("ada", "Q2"), ("aDa", "Q2"), ("old", None), (None, None), ("new", None)}
    assert [tuple(r) for r in cache.top().collect()] == [("ada", 3), ("old", 1)]
    cache.set(spark.createDataFrame([("ada", "Q9", "f", "{}", now)], schema))
    assert tuple(cache.stats().first()) == (2, 2) and ask("Ada")[0]["wikidata_id"] == "Q9"
    assert cache.table.versions() == [1, 2, 3, 4]  # a get without hits publishes nothing


def test_layout_cache(spark, tmp_path):
    cache = LayoutCache(spark, str(tmp_path / "l"))
    now, schema = datetime(2001, 8, 1, 12), "article_id long, width int, height int, layout string, computed_at timestamp_ntz"
    put = lambda *r: cache.put(spark.createDataFrame(list(r), schema))
    assert cache.alive(now).collect() == []
    put((1, 1210, 600, "a", datetime(2001, 7, 31, 13)), (2, 1200, 600, "b", datetime(2001, 7, 31, 11)))
    put((1, 1190, 640, "c", datetime(2001, 8, 1, 1)), (3, 1200, 600, "d", datetime(2001, 7, 29)), (4, 1200, 600, "later", datetime(2001, 8, 1, 13)))
    asked = spark.createDataFrame([(k, 1200, 600) for k in (1, 2, 3, 4)], "article_id long, width int, height int")
    assert {r["article_id"]: r["layout"] for r in cache.get(asked, now).collect()} == {1: "c", 2: None, 3: None, 4: None}
    before = cache.table.manifest()["parts"]
    cache.purge(now)
    after = cache.table.manifest()["parts"]
    assert set(before) == {"2001-07-29", "2001-07-31", "2001-08-01"} and set(after) == {"2001-07-31", "2001-08-01"}
    assert after["2001-08-01"] == before["2001-08-01"] and after["2001-07-31"] != before["2001-07-31"]  # whole days aren't touched
    assert {r["layout"] for r in cache.table.read().collect()} == {"a", "c", "later"}
    assert cache.purge(datetime(2001, 7, 1)) == cache.table.versions()[-1]
    plan = cache.table.read(["2001-07-31"])._jdf.queryExecution().toString()
    assert "2001-08-01" not in plan
