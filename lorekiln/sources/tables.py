"""Sources and sinks: files, feeds, upserts as joins, caches, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.proxy import Model, over
from ..plans.registry import query


def merged(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """``old`` with the rows of ``new`` upserted by key.

    ``policy`` says for each further column what a conflict keeps: old, new, greatest, union (arrays),
    old_else_new or new_else_old.  Both sides must be unique by key.
    """
    o, n = F.col("o._there").isNotNull(), F.col("n._there").isNotNull()

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if policy[c] == "union":
            return F.when(o & n, F.array_sort(F.array_union(F.coalesce(a, b), F.coalesce(b, a)))).when(o, a).otherwise(b).alias(c)
        both = {
            "old": a,
            "new": b,
            "greatest": F.greatest(a, b),
            "old_else_new": F.coalesce(a, b),
            "new_else_old": F.coalesce(b, a),
        }[policy[c]]
        return F.when(o & n, both).when(o, a).otherwise(b).alias(c)

    left = old.withColumn("_there", F.lit(1)).alias("o")
    right = new.withColumn("_there", F.lit(1)).alias("n")
    joined = left.join(right, keys, "full")
    return joined.select(*keys, *[pick(c) for c in policy])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def write_replacing(df: DataFrame, path: str, partition: str) -> None:
    """Only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.{txt,htm,html}") -> DataFrame:
    """id (the file's stem), is_html and content of text files."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("id"), name.rlike(r"\.html?$").alias("is_html"), F.col("value").alias("content"))


#: An item of RSS or an entry of Atom; prefixed elements keep their prefix, or lose it where the reader ignores namespaces.
TEXT = "struct<_VALUE: string, _type: string>"
ITEM = "title string, link string, description string, `content:encoded` string, encoded string, content string, author string, `dc:creator` string, creator string, pubDate string"
ENTRY = f"title {TEXT}, link array<struct<_href: string, _rel: string>>, summary {TEXT}, content array<{TEXT}>, author struct<name: string>, published string, updated string"
#: Dates of feeds, less the weekday: RFC 822 with numeric zones and names, and ISO 8601.
DATES = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"]


def feed_date(c: Column) -> Column:
    """A feed's date as a timestamp; null if it has none of the known forms."""
    bare = F.regexp_replace(F.trim(c), r"^\p{L}+,\s*", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in DATES])


def _articles(entries: DataFrame, names: dict[str, str]) -> DataFrame:
    """Articles from (title, url, content, summary, author, published, source): content, or else the summary; without title or url none."""
    filled = entries.where("coalesce(title, '') <> '' AND coalesce(url, '') <> ''")
    source = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("source")], "source") if names else F.col("source")
    return filled.select(
        F.sha2(F.concat_ws("||", "url", "title"), 256).alias("article_hash"),
        "title",
        "url",
        F.coalesce(F.nullif("content", F.lit("")), "summary", F.lit("")).alias("content"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("author", F.lit("")).alias("author"),
        feed_date(F.col("published")).alias("published_date"),
        source.alias("source"),
    )


def read_feed(spark: SparkSession, path: str, source: str = "", names: dict[str, str] | None = None) -> DataFrame:
    """Articles of RSS files (``item``) and Atom files (``entry``) below ``path``; ``source`` names the feed, ``names`` maps titles to names.

    An entry's content is its first content element (content:encoded in RSS), else its summary; its address is
    the alternate link; its date is that of publication, else of the last update.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("valueTag", "_VALUE").schema(schema).load(path)
    rss = read("item", ITEM).select(
        F.trim("title").alias("title"), F.trim("link").alias("url"), F.coalesce("content:encoded", "encoded", "content").alias("content"),
        F.col("description").alias("summary"), F.coalesce("author", "dc:creator", "creator").alias("author"), F.col("pubDate").alias("published"),
    )
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = read("entry", ENTRY).select(
        F.trim("title._VALUE").alias("title"), F.trim(F.get(alternate, F.lit(0))["_href"]).alias("url"), F.get("content", F.lit(0))["_VALUE"].alias("content"),
        F.col("summary._VALUE").alias("summary"), F.col("author.name").alias("author"), F.coalesce("published", "updated").alias("published"),
    )
    return _articles(rss.unionByName(atom).withColumn("source", F.lit(source)), names or {})


#: Characters below which a fetched text is no article.
LEAST_TEXT = 100


def full_text(articles: DataFrame, fetched: str = "fetched") -> DataFrame:
    """``articles`` with their fetched text as content where it has at least 100 characters, else with the content they had."""
    long_enough = F.char_length(F.col(fetched)) >= LEAST_TEXT
    return articles.withColumns({"full_text": F.coalesce(long_enough, F.lit(False)), "content": F.when(long_enough, F.col(fetched)).otherwise(F.col("content"))}).drop(fetched)


@query("s03_full_text", "SELECT doc_id, length(text) >= 100 AS full_text, CASE WHEN length(text) >= 100 THEN text ELSE 'summary' END AS content FROM documents")
def s03(m: Model) -> DataFrame:
    return full_text(m.table("documents").select("doc_id", F.lit("summary").alias("content"), F.col("text").alias("fetched")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_by_article(df: DataFrame, path: str, key: str = "article_id") -> None:
    """One folder, and in it one JSON file, for each article."""
    df.withColumn("_key", F.col(key)).repartition("_key").sortWithinPartitions("_key").write.mode("overwrite").partitionBy("_key").json(path)


def backup(df: DataFrame, path: str, stamp: str, keep: int = 7) -> list[str]:
    """A compressed copy of a table below ``path`` under a sortable ``stamp``; of all copies the latest ``keep`` stay.  Gives their names."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{stamp}")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted(s.getPath().getName() for s in files.listStatus(root) if s.isDirectory())
    for old in names[:-keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, old), True)
    return names[-keep:]


def restore(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{stamp}")


def export_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("row"))


def schema_check(spark: SparkSession, found: dict[str, list[str]], expected: dict[str, list[str]]) -> DataFrame:
    """(table, column, status) of every column that is expected or there: found, missing or extra."""
    pairs = lambda tables: spark.createDataFrame([(t, c) for t, columns in tables.items() for c in columns], "`table` string, `column` string")
    there, wanted = pairs(found).withColumn("there", F.lit(True)), pairs(expected).withColumn("wanted", F.lit(True))
    status = F.when(F.col("there") & F.col("wanted"), "found").when(F.col("wanted"), "missing").otherwise("extra")
    return there.join(wanted, ["table", "column"], "full").select("table", "column", status.alias("status"))


def missing_tables(spark: SparkSession, expected: dict[str, list[str]]) -> DataFrame:
    """The catalog's tables against the expected ones."""
    return schema_check(spark, {t: spark.table(t).columns for t in expected if spark.catalog.tableExists(t)}, expected)


@query("s17_schema_check", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'found'), ('nation', 'n_name', 'found'), ('nation', 'n_flag', 'missing'), ('nation', 'n_regionkey', 'extra'), ('region', 'r_regionkey', 'found'), ('region', 'r_name', 'extra'), ('gone', 'id', 'missing')) v(\"table\", \"column\", status)")
def s17(m: Model) -> DataFrame:
    found = {t: [c for c in m.table(t).columns if not c.endswith("comment")] for t in ("nation", "region")}
    return schema_check(m.spark, found, {"nation": ["n_nationkey", "n_name", "n_flag"], "region": ["r_regionkey"], "gone": ["id"]})


def cached_lookup(names: DataFrame, cache: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """``names`` (entity_name) with what a lower-cased cache of at most ``days`` days holds of them, and the hits after this one."""
    fresh = cache.where(F.col("cached_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    joined = names.withColumn("_k", F.lower("entity_name")).join(fresh.withColumn("_k", F.lower(F.col("entity_name"))).drop("entity_name"), "_k", "left")
    return joined.withColumn("hit_count", F.col("hit_count") + 1).drop("_k")


def layout_key(article: Column, width: Column, height: Column) -> Column:
    side = lambda c: (F.bround(c / 100) * 100).cast("int").cast("string")
    return F.sha2(F.concat(F.lit("article_"), article.cast("string"), F.lit("_w"), side(width), F.lit("_h"), side(height)), 256)


_OLD, _NEW = "id % 3 <> 0", "id % 2 = 0"


def _sides(m: Model) -> tuple[DataFrame, DataFrame]:
    a = m.articles.select("id", "url", "title", "source", F.lit("old").alias("summary"))
    return a.where(_OLD), a.where(_NEW).withColumns({"title": F.concat("title", F.lit(" (updated)")), "source": F.lit("new"), "summary": F.lit("new")})


@query("s06_article_upsert", over("articles", f"SELECT id, url, CASE WHEN {_NEW} THEN title || ' (updated)' ELSE title END AS title, CASE WHEN {_OLD} THEN source ELSE 'new' END AS source, CASE WHEN {_NEW} THEN 'new' ELSE 'old' END AS summary FROM articles WHERE {_OLD} OR {_NEW}"))
def s06(m: Model) -> DataFrame:
    old, new = _sides(m)
    return merged(old, new, ["url"], {"id": "old", "title": "new", "source": "old", "summary": "new"}).select("id", "url", "title", "source", "summary")


@query("s07_result_upsert", over("facts", "SELECT article_id, max(confidence) AS similarity, bool_or(wikidata_id IS NOT NULL) AS had_conflicts FROM facts GROUP BY 1"))
def s07(m: Model) -> DataFrame:
    rows = m.facts.groupBy("article_id").agg(F.max("confidence").alias("similarity"), F.expr("bool_or(wikidata_id IS NOT NULL)").alias("had_conflicts"))
    stale = rows.where("article_id % 2 = 0").withColumn("similarity", F.lit(0.0))
    return merged(stale, rows.withColumn("had_conflicts", F.when(F.col("article_id") % 2 != 0, F.col("had_conflicts"))), ["article_id"], {"similarity": "new", "had_conflicts": "old"})


@query("s08_facts_upsert", "WITH r AS (SELECT l_orderkey AS article_id, l_partkey AS part, l_returnflag AS f, l_quantity AS q FROM lineitem) SELECT article_id, part, max(q) AS confidence, array_to_string(list_sort(list(DISTINCT f)), ',') AS models FROM r WHERE f IN ('A', 'N') GROUP BY 1, 2")
def s08(m: Model) -> DataFrame:
    side = lambda flag: m.table("lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("part")).agg(F.max("l_quantity").alias("confidence"), F.collect_set("l_returnflag").alias("models"))
    both = merged(side("A"), side("N"), ["article_id", "part"], {"confidence": "greatest", "models": "union"})
    return both.withColumn("models", F.array_join("models", ","))


@query("s09_insert_missing", over("articles", f"SELECT id, CASE WHEN {_OLD} THEN 'old' ELSE 'new' END AS summary FROM articles WHERE {_OLD} OR {_NEW}"))
def s09(m: Model) -> DataFrame:
    old, new = _sides(m)
    return insert_missing(old, new, ["url"]).select("id", "summary")


@query("s10_regenerate_by_type", over("articles", "SELECT processing_status AS relationship_type, CASE WHEN processing_status = 'failed' THEN 'kept' ELSE 'fresh' END AS origin, count(*) AS n FROM articles GROUP BY 1, 2"))
def s10(m: Model) -> DataFrame:
    rows = m.articles.select(F.col("processing_status").alias("relationship_type"))
    kept = rows.where("relationship_type NOT IN ('completed', 'pending')").withColumn("origin", F.lit("kept"))
    fresh = rows.where("relationship_type IN ('completed', 'pending')").withColumn("origin", F.lit("fresh"))
    return kept.unionByName(fresh).groupBy("relationship_type", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("s11_status_update", over("articles", "SELECT id, CASE WHEN id % 10 = 0 THEN 'failed' ELSE processing_status END AS processing_status FROM articles"))
def s11(m: Model) -> DataFrame:
    old = m.articles.select("id", "processing_status")
    return merged(old, old.where("id % 10 = 0").withColumn("processing_status", F.lit("failed")), ["id"], {"processing_status": "new"})


@query("s12_cost_log", "SELECT o_orderkey AS article_id, o_custkey AS input_tokens, o_orderkey % 1000 AS output_tokens, o_custkey + o_orderkey % 1000 AS total_tokens FROM orders")
def s12(m: Model) -> DataFrame:
    logged = m.table("orders").selectExpr("o_orderkey AS article_id", "o_custkey AS input_tokens", "o_orderkey % 1000 AS output_tokens")
    return logged.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


@query("s13_topic_snapshot", over("article_topics articles", "SELECT topic_id, count(*) AS article_count, string_agg(title, '|' ORDER BY id) FILTER (WHERE k <= 3) AS representative FROM (SELECT topic_id, a.id, title, row_number() OVER (PARTITION BY topic_id ORDER BY a.id) AS k FROM article_topics x JOIN articles a ON a.id = x.article_id WHERE topic_id <> 0) GROUP BY 1"))
def s13(m: Model) -> DataFrame:
    named = m.article_topics.where("topic_id <> 0").join(m.articles.select(F.col("id").alias("article_id"), "title"), "article_id")
    first = Window.partitionBy("topic_id").orderBy("article_id")
    best = named.withColumn("k", F.row_number().over(first)).where("k <= 3").groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "title")))["title"], "|").alias("representative"))
    return named.groupBy("topic_id").agg(F.count(F.lit(1)).alias("article_count")).join(best, "topic_id").select("topic_id", "article_count", "representative")


@query("s14_cached_lookup", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey END AS wikidata_id, CASE WHEN c_custkey % 2 = 0 THEN 2 END AS hit_count FROM customer")
def s14(m: Model) -> DataFrame:
    names = m.table("customer").select("c_custkey", F.col("c_name").alias("entity_name"))
    cache = names.selectExpr("upper(entity_name) AS entity_name", "concat('Q', c_custkey) AS wikidata_id", "1 AS hit_count", "CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP_NTZ'2001-07-31' ELSE TIMESTAMP_NTZ'2001-01-01' END AS cached_at")
    return cached_lookup(names, cache, F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")).select("c_custkey", "wikidata_id", "hit_count")


@query("s15_layout_key", "SELECT o_orderkey, sha256('article_' || o_orderkey || '_w' || CAST(round_even(o_custkey / 100.0, 0) * 100 AS INTEGER) || '_h600') AS cache_key FROM orders")
def s15(m: Model) -> DataFrame:
    return m.table("orders").select("o_orderkey", layout_key(F.col("o_orderkey"), F.col("o_custkey"), F.lit(600)).alias("cache_key"))


@query("s01_table_scan", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'")
def s01(m: Model) -> DataFrame:
    return m.table("lineitem").where("l_shipdate >= TIMESTAMP_NTZ'2001-01-01'").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("s16_export_rows", over("articles", "SELECT '{\"id\":' || id || ',\"url\":\"' || url || '\",\"title\":\"' || title || '\"}' AS row FROM articles"))
def s16(m: Model) -> DataFrame:
    return export_rows(m.articles.select("id", "url", "title"))
