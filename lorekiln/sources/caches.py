"""Caches that expire: answers of an outside service by name, and computed layouts, both as snapshot tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.proxy import AS_OF, Model
from ..plans.registry import query
from ..plans.shared import materialize, release, shared_dir
from .snapshots import Snapshots, by_hash
from .tables import layout_key

#: Days that an answer serves, and hours that a layout does.
ANSWER_DAYS, LAYOUT_HOURS = 30, 24
TOP = 10


class LookupCache:
    """Answers by lower-cased name.  Setting a name replaces its row and starts its hits at 1; a get counts as a hit for each name asked.

    Null names are neither kept nor found.  Of several new rows of one name the latest counts.
    """

    ANSWER = ("wikidata_id", "description", "properties")

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        schema = "entity_name string, wikidata_id string, description string, properties string, cached_at timestamp_ntz, hit_count long"
        self.table = Snapshots(spark, path, schema, by_hash(["entity_name"], parts))

    def set(self, rows: DataFrame) -> int:
        """Keep rows (entity_name, wikidata_id, description, properties, cached_at).  Gives the version."""
        named = rows.where("entity_name IS NOT NULL").withColumns({"entity_name": F.lower("entity_name"), "hit_count": F.lit(1).cast("long")})
        return self.table.upsert(named, ["entity_name"], order="cached_at")

    def get(self, names: DataFrame, as_of: datetime, days: int = ANSWER_DAYS) -> DataFrame:
        """``names`` (entity_name and whatever else) with the answers of at most ``days`` days, null where there is none; counts the hits.

        Answers are those of one version; only the partitions of the names are read and replaced.
        """
        base = self.table.manifest()
        asked = names.where("entity_name IS NOT NULL").groupBy(F.lower("entity_name").alias("entity_name")).agg(F.count(F.lit(1)).alias("asked"))
        asked = materialize(asked, "asked")
        parts = self.table.parts_of(asked)
        held = self.table.read(parts, base["version"]).join(asked, "entity_name", "left")
        fresh = F.col("asked").isNotNull() & (F.col("cached_at") >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))
        answers = materialize(held.withColumn("fresh", fresh), "answers")
        if answers.where("fresh").limit(1).count():
            counted = F.col("hit_count") + F.when(F.col("fresh"), F.col("asked")).otherwise(F.lit(0))
            self.table.commit(answers.withColumn("hit_count", counted), base)
        release(asked)
        found = answers.where("fresh").select(F.col("entity_name").alias("_name"), *self.ANSWER)
        return names.join(found, F.lower("entity_name") == F.col("_name"), "left").drop("_name")

    def stats(self) -> DataFrame:
        """One row: total_cached, total_hits."""
        return self.table.read().agg(F.count(F.lit(1)).alias("total_cached"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"))

    def top(self, n: int = TOP) -> DataFrame:
        """The names asked most often, first those of more hits, then by name."""
        return self.table.read().orderBy(F.desc("hit_count"), "entity_name").limit(n).select("entity_name", "hit_count")


class LayoutCache:
    """Layouts by article and viewport, partitioned by the day of their computation; the latest of a key serves.

    A put adds files to its day and reads nothing.  A get reads the days that can hold rows still alive.
    A purge drops whole days from the manifest and rewrites the one day that the limit falls in.
    """

    def __init__(self, spark: SparkSession, path: str):
        schema = "cache_key string, article_id long, layout string, computed_at timestamp_ntz"
        self.table = Snapshots(spark, path, schema, F.to_date("computed_at"))

    def put(self, rows: DataFrame) -> int:
        """Keep rows (article_id, width, height, layout, computed_at).  Gives the version."""
        keyed = rows.withColumn("cache_key", layout_key(F.col("article_id"), F.col("width"), F.col("height")))
        return self.table.commit(keyed, append=True)

    def _days(self, since: datetime, until: datetime) -> list[str]:
        return [str((since + timedelta(days=k)).date()) for k in range((until.date() - since.date()).days + 1)]

    def alive(self, as_of: datetime, hours: int = LAYOUT_HOURS) -> DataFrame:
        """The latest row of each key, of those computed in the ``hours`` hours up to ``as_of``."""
        since = as_of - timedelta(hours=hours)
        rows = self.table.read(self._days(since, as_of)).where((F.col("computed_at") > F.lit(since).cast("timestamp_ntz")) & (F.col("computed_at") <= F.lit(as_of).cast("timestamp_ntz")))
        last = F.max_by(F.struct("article_id", "layout", "computed_at"), F.struct("computed_at", "layout")).alias("last")
        return rows.groupBy("cache_key").agg(last).select("cache_key", "last.*")

    def get(self, asked: DataFrame, as_of: datetime, hours: int = LAYOUT_HOURS) -> DataFrame:
        """``asked`` (article_id, width, height) with layout and computed_at, null where none is alive."""
        key = layout_key(F.col("article_id"), F.col("width"), F.col("height"))
        found = self.alive(as_of, hours).drop("article_id")
        return asked.withColumn("cache_key", key).join(found, "cache_key", "left")

    def purge(self, as_of: datetime, hours: int = LAYOUT_HOURS) -> int:
        """Remove what was computed before ``hours`` hours ago.  Gives the version."""
        limit = as_of - timedelta(hours=hours)
        base = self.table.manifest()
        edge = str(limit.date())
        gone = [day for day in base["parts"] if day < edge]
        rest = None
        if edge in base["parts"]:
            gone.append(edge)
            rest = self.table.read([edge], base["version"]).where(F.col("computed_at") >= F.lit(limit).cast("timestamp_ntz"))
        return self.table.commit(rest, base, drop=gone) if gone else base["version"]


_NOW = datetime.fromisoformat(AS_OF)


def _filled(m: Model) -> LookupCache:
    """Customers' names: all set, of two ages; asked in capitals, a third of them twice; a fifth set anew; asked again."""
    cache = LookupCache(m.spark, f"{shared_dir(m.spark)}/lookup", 8)
    age = "CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP_NTZ'2001-07-20' ELSE TIMESTAMP_NTZ'2001-06-01' END AS cached_at"
    rows = m.table("customer").selectExpr("c_custkey", "c_name AS entity_name", "concat('Q', c_custkey) AS wikidata_id", "CAST(c_nationkey AS STRING) AS description", "'{}' AS properties", age)
    cache.set(rows)
    asked = rows.select("c_custkey", F.upper("entity_name").alias("entity_name"))
    cache.get(asked.unionByName(asked.where("c_custkey % 3 = 0")), _NOW)
    cache.set(rows.where("c_custkey % 5 = 0").withColumns({"description": F.lit("new"), "cached_at": F.lit(_NOW).cast("timestamp_ntz")}))
    return cache


#: The customers' hits after all this, as DuckDB text.
_HITS = """h AS (SELECT c_custkey, c_name, c_nationkey, c_custkey % 5 = 0 AS renewed, c_custkey % 5 = 0 OR c_custkey % 2 = 0 AS fresh,
  CASE WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END ELSE 1 END AS hits FROM customer)"""


@query("s14b_cache_get_after_set", f"WITH {_HITS} SELECT c_custkey, CASE WHEN fresh THEN 'Q' || c_custkey END AS wikidata_id, CASE WHEN renewed THEN 'new' WHEN fresh THEN CAST(c_nationkey AS VARCHAR) END AS description FROM h")
def s14b(m: Model) -> DataFrame:
    asked = m.table("customer").select("c_custkey", F.col("c_name").alias("entity_name"))
    return _filled(m).get(asked, _NOW).select("c_custkey", "wikidata_id", "description")


@query("s14c_cache_stats", f"WITH {_HITS} SELECT count(*) AS total_cached, CAST(sum(hits) AS BIGINT) AS total_hits FROM h")
def s14c(m: Model) -> DataFrame:
    return _filled(m).stats()


@query("s14d_cache_top", f"WITH {_HITS} SELECT lower(c_name) AS entity_name, CAST(hits AS BIGINT) AS hit_count FROM h ORDER BY hits DESC, lower(c_name) LIMIT 10")
def s14d(m: Model) -> DataFrame:
    return _filled(m).top()


def _laid_out(m: Model) -> LayoutCache:
    """Orders' layouts of the last three days, a seventh of them computed anew half a day later."""
    cache = LayoutCache(m.spark, f"{shared_dir(m.spark)}/layouts")
    at = f"TIMESTAMP_NTZ'{AS_OF}' - make_dt_interval(0, CAST(o_orderkey % 72 AS INT) + 12, 0, 0)"
    rows = m.table("orders").selectExpr("o_orderkey AS article_id", "o_custkey AS width", "600 AS height", "concat('{\"n\":', o_custkey, '}') AS layout", f"{at} AS computed_at")
    cache.put(rows)
    cache.put(rows.where("article_id % 7 = 0").withColumns({"layout": F.lit("{}"), "computed_at": F.expr("computed_at + INTERVAL 12 HOURS")}))
    return cache


_LAYOUTS = """l AS (SELECT o_orderkey AS article_id, o_custkey, CAST(o_orderkey % 72 AS INTEGER) + CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 12 END AS age,
  sha256('article_' || o_orderkey || '_w' || CAST(round_even(o_custkey / 100.0, 0) * 100 AS INTEGER) || '_h600') AS cache_key FROM orders)"""


@query("s15b_layouts_alive", f"WITH {_LAYOUTS} SELECT article_id, cache_key, CASE WHEN article_id % 7 = 0 THEN '{{}}' ELSE '{{\"n\":' || o_custkey || '}}' END AS layout FROM l WHERE age < 24")
def s15b(m: Model) -> DataFrame:
    return _laid_out(m).alive(_NOW).select("article_id", "cache_key", "layout")


@query("s15c_layout_get", f"WITH {_LAYOUTS} SELECT article_id, CASE WHEN age < 24 THEN CASE WHEN article_id % 7 = 0 THEN '{{}}' ELSE '{{\"n\":' || o_custkey || '}}' END END AS layout FROM l")
def s15c(m: Model) -> DataFrame:
    asked = m.table("orders").selectExpr("o_orderkey AS article_id", "o_custkey AS width", "600 AS height")
    return _laid_out(m).get(asked, _NOW).select("article_id", "layout")


@query("s15d_layout_purge", """WITH r AS (SELECT o_orderkey AS article_id, CAST(o_orderkey % 72 AS INTEGER) + 12 AS age FROM orders UNION ALL SELECT o_orderkey, CAST(o_orderkey % 72 AS INTEGER) FROM orders WHERE o_orderkey % 7 = 0)
SELECT age, count(*) AS n FROM r WHERE age <= 48 GROUP BY age""")
def s15d(m: Model) -> DataFrame:
    cache = _laid_out(m)
    cache.purge(_NOW, 48)
    age = F.expr(f"CAST((unix_seconds(CAST(TIMESTAMP_NTZ'{AS_OF}' AS TIMESTAMP)) - unix_seconds(CAST(computed_at AS TIMESTAMP))) / 3600 AS INT)").alias("age")
    return cache.table.read().groupBy(age).agg(F.count(F.lit(1)).alias("n"))
