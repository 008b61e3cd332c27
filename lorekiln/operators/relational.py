"""Filters, joins, sorts, limits and set operations over the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.proxy import AS_OF, Model, over
from ..plans.registry import query
from ..plans.shared import materialize
from .aggregates import days_before, ts

PAIR = ("least(x, y) AS entity_a", "greatest(x, y) AS entity_b")


def recent_articles(articles: DataFrame, status: str | None = None, source: str | None = None, days: int | None = None, as_of: str = AS_OF) -> DataFrame:
    """Articles by status, source and age; the date stays a bare column, so that the scan can use it."""
    if status:
        articles = articles.where(F.col("processing_status") == status)
    if source:
        articles = articles.where(F.col("source") == source)
    return articles.where((F.col("published_date") >= days_before(as_of, days)) & (F.col("published_date") <= ts(as_of))) if days else articles


@query("f01_recent_articles", over("articles", "SELECT id, title, source, published_date FROM articles WHERE source = '1-URGENT' AND published_date >= TIMESTAMP '2001-07-02' AND published_date <= TIMESTAMP '2001-08-01'"))
def f01(m: Model) -> DataFrame:
    return recent_articles(m.articles, None, "1-URGENT", 30).select("id", "title", "source", "published_date")


def with_facts(articles: DataFrame, facts: DataFrame) -> DataFrame:
    """Articles with at least one fact."""
    return articles.join(facts.select(F.col("article_id").alias("id")), "id", "left_semi")


@query("f02_articles_with_facts", over("articles facts", "SELECT id, source FROM articles a WHERE EXISTS (SELECT 1 FROM facts f WHERE f.article_id = a.id AND f.confidence >= 0.9)"))
def f02(m: Model) -> DataFrame:
    return with_facts(m.articles, m.facts.where("confidence >= 0.9D")).select("id", "source")


@query("f03_facts_in_subquery", over("articles facts", "SELECT article_id, entity FROM facts WHERE article_id IN (SELECT id FROM articles WHERE published_date >= TIMESTAMP '2001-07-25')"))
def f03(m: Model) -> DataFrame:
    recent = m.articles.where("published_date >= TIMESTAMP_NTZ'2001-07-25'").select(F.col("id").alias("article_id"))
    return m.facts.join(recent, "article_id", "left_semi").select("article_id", "entity")


def in_list(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Membership in a list; no list, no filter."""
    return df if values is None else df.where(F.col(column).isin(values))


@query("f04_any_of", over("facts", "SELECT article_id, entity FROM facts WHERE entity_type IN ('PROMO', 'SMALL')"))
def f04(m: Model) -> DataFrame:
    return in_list(m.facts, "entity_type", ["PROMO", "SMALL"]).select("article_id", "entity")


@query("f05_pending_queue", over("articles", "SELECT id, title, published_date FROM articles WHERE processing_status = 'pending' AND title IS NOT NULL ORDER BY published_date DESC NULLS FIRST, id LIMIT 50"))
def f05(m: Model) -> DataFrame:
    waiting = m.articles.where("processing_status = 'pending' AND title IS NOT NULL")
    return waiting.orderBy(F.desc_nulls_first("published_date"), "id").limit(50).select("id", "title", "published_date")


@query("f06_topic_corpus", over("texts", "SELECT id, lang FROM texts WHERE content IS NOT NULL AND length(content) >= 500"))
def f06(m: Model) -> DataFrame:
    return m.texts.where("content IS NOT NULL AND char_length(content) >= 500").select("id", "lang")


@query("f24_text_search", over("texts", "SELECT id FROM texts WHERE contains(lower(coalesce(title, '')), 'the') OR contains(lower(content), 'idiot') OR CAST(id AS VARCHAR) = '42'"))
def f24(m: Model) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return m.texts.where(F.contains(low("title"), F.lit("the")) | F.contains(low("content"), F.lit("idiot")) | (F.col("id").cast("string") == "42")).select("id")


@query("f25_entity_facet", over("articles facts", "SELECT id FROM articles WHERE source = '2-HIGH' AND id IN (SELECT article_id FROM facts WHERE entity = 'E0000007')"))
def f25(m: Model) -> DataFrame:
    return with_facts(m.articles.where("source = '2-HIGH'"), m.facts.where("entity = 'E0000007'")).select("id")


@query("j01_left_extraction", over("articles facts", "SELECT a.id, coalesce(e.n, 0) AS fact_count, e.mean AS mean_confidence FROM articles a LEFT JOIN (SELECT article_id, count(*) AS n, round(avg(confidence), 6) AS mean FROM facts WHERE confidence >= 0.5 GROUP BY article_id) e ON e.article_id = a.id"))
def j01(m: Model) -> DataFrame:
    results = m.facts.where("confidence >= 0.5D").groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return m.articles.select("id").join(results, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("fact_count"), "mean_confidence")


@query("j02_facts_of_articles", over("articles facts", "SELECT a.source, f.entity_type, count(*) AS n FROM facts f JOIN articles a ON a.id = f.article_id WHERE a.processing_status = 'completed' GROUP BY 1, 2"))
def j02(m: Model) -> DataFrame:
    done = m.articles.where("processing_status = 'completed'").select(F.col("id").alias("article_id"), "source")
    return m.facts.join(done, "article_id").groupBy("source", "entity_type").agg(F.count(F.lit(1)).alias("n"))


#: Facts of a task that makes pairs of them.
PAIR_ROWS = 1 << 16


def dealt(facts: DataFrame, rows: int = PAIR_ROWS) -> DataFrame:
    """``facts`` written once, and read in partitions by article of about so many rows: what a task holds of their pairs doesn't grow with the input."""
    held = materialize(facts, "facts")
    return held.repartition(max(1, -(-held.count() // rows)), "article_id")


def entity_pairs(facts: DataFrame) -> DataFrame:
    """Every pair a < b of an article's entities with both confidences: an equi join with an inequality left over."""
    a = facts.select("article_id", F.col("entity").alias("entity_a"), F.col("confidence").alias("confidence_a"))
    b = facts.select("article_id", F.col("entity").alias("entity_b"), F.col("confidence").alias("confidence_b"))
    return a.join(b, "article_id").where("entity_a < entity_b")


@query("j03_entity_pairs", over("facts", "SELECT a.article_id, a.entity AS entity_a, b.entity AS entity_b, round((a.confidence + b.confidence) / 2, 6) AS confidence FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity WHERE a.confidence >= 0.6 AND b.confidence >= 0.6"))
def j03(m: Model) -> DataFrame:
    pairs = entity_pairs(m.facts.where("confidence >= 0.6D"))
    return pairs.select("article_id", "entity_a", "entity_b", F.round((F.col("confidence_a") + F.col("confidence_b")) / 2, 6).alias("confidence"))


@query("j04_latest_snapshot", over("topics", "SELECT t.topic_id, t.topic_label, l.snapshot FROM topics t CROSS JOIN (SELECT max(snapshot) AS snapshot FROM topics) l WHERE t.snapshot = l.snapshot"))
def j04(m: Model) -> DataFrame:
    latest = m.topics.agg(F.max("snapshot").alias("latest"))  # one row, whatever the input: safe to broadcast
    return m.topics.crossJoin(F.broadcast(latest)).where("snapshot = latest").select("topic_id", "topic_label", "snapshot")


@query("j05_topic_articles_outer", over("topics article_topics articles", "SELECT t.topic_id, count(a.id) AS recent FROM topics t LEFT JOIN article_topics x ON x.topic_id = t.topic_id LEFT JOIN articles a ON a.id = x.article_id WHERE a.published_date IS NULL OR a.published_date >= TIMESTAMP '2001-01-01' GROUP BY t.topic_id"))
def j05(m: Model) -> DataFrame:
    chain = m.topics.join(m.article_topics, "topic_id", "left").join(m.articles, F.col("article_id") == F.col("id"), "left")
    return chain.where("published_date IS NULL OR published_date >= TIMESTAMP_NTZ'2001-01-01'").groupBy("topic_id").agg(F.count("id").alias("recent"))


@query("j07_insert_if_absent", over("articles", "SELECT id, url FROM articles n WHERE id % 7 = 0 AND NOT EXISTS (SELECT 1 FROM articles o WHERE o.id % 14 = 0 AND o.url = n.url)"))
def j07(m: Model) -> DataFrame:
    stored = m.articles.where("id % 14 = 0").select("url")
    return m.articles.where("id % 7 = 0").join(stored, "url", "left_anti").select("id", "url")


@query("j10_containment_match", "WITH l AS (SELECT DISTINCT l_orderkey AS article_id, p_type AS type, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT DISTINCT article_id, split_part(name, ' ', 2) AS name, type FROM l) SELECT s.article_id, s.name AS short_name, l.name AS long_name FROM s JOIN l ON s.article_id = l.article_id AND s.type = l.type AND contains(lower(l.name), lower(s.name)) AND s.name <> l.name")
def j10(m: Model) -> DataFrame:
    e = m.table("lineitem").join(m.table("part"), F.col("p_partkey") == F.col("l_partkey")).selectExpr("l_orderkey AS article_id", "p_type AS type", "p_name AS name").distinct()
    short = e.select("article_id", "type", F.split_part("name", F.lit(" "), F.lit(2)).alias("name")).distinct()
    return containment_matches(short, e).select("article_id", "short_name", "long_name")


#: Characters of the pieces that names are looked up by.
GRAM = 3


def _grams(name: Column, size: Column) -> Column:
    """The distinct pieces of a name of one size: of size 0 the empty one, none where the name is shorter."""
    starts = F.sequence(F.lit(1), F.char_length(name) - size + 1)
    pieces = F.array_distinct(F.transform(starts, lambda at: F.substring(name, at, size)))
    return F.when(size == 0, F.array(F.lit(""))).when(F.char_length(name) >= size, pieces).otherwise(F.array().cast("array<string>"))


#: Long names of one article and type that a short name is compared with one by one.
FEW = 64


def containment_matches(left: DataFrame, right: DataFrame, few: int = FEW) -> DataFrame:
    """Names of one type in one article of which one holds the other, whatever the case: article_id, type, short_name and long_name for each two rows.

    In groups of few long names a short one is compared with all.  In others long names are listed by their pieces of
    up to GRAM characters, and each short name looks at the list of its rarest piece alone, which any name that holds
    it is on; what is found there is verified.  So an article of thousands of names doesn't compare all of them, and
    pieces, many for each name, are made only there.  An empty name is held by all.
    """
    key = ["article_id", "type"]

    def named(df: DataFrame, c: str) -> DataFrame:
        counted = df.where("name IS NOT NULL").groupBy(*key, F.col("name").alias(f"{c}_name")).agg(F.count(F.lit(1)).alias(f"{c}_rows"))
        return counted.withColumn(f"{c}_low", F.lower(f"{c}_name"))

    held = named(right, "long").withColumn("group", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    short = named(left, "short")
    holds = F.contains("long_low", "short_low") & (F.col("short_name") != F.col("long_name"))
    names = [*key, "short_name", "short_rows", "long_name", "long_rows"]
    near = short.join(held.where(F.col("group") <= few), key).where(holds).select(*names)
    sizes = F.sequence(F.lit(0), F.lit(GRAM))
    listed = held.where(F.col("group") > few).withColumn("gram", F.explode(F.flatten(F.transform(sizes, lambda n: _grams(F.col("long_low"), n)))))
    lists = listed.groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("listed"))
    crowded = short.join(listed.select(*key).distinct(), key, "left_semi")
    pieces = crowded.withColumn("gram", F.explode(_grams(F.col("short_low"), F.least(F.char_length("short_low"), F.lit(GRAM)))))
    known = pieces.join(lists, [*key, "gram"], "left")  # a piece without a list: no name holds the short one
    least = F.min(F.struct(F.coalesce("listed", F.lit(0)).alias("listed"), "gram")).alias("least")
    rarest = known.groupBy(*key, "short_name", "short_rows", "short_low").agg(least).where("least.listed > 0").withColumn("gram", F.col("least.gram"))
    found = near.unionByName(rarest.join(listed, [*key, "gram"]).where(holds).select(*names))
    times = F.sequence(F.lit(1), (F.col("short_rows") * F.col("long_rows")).cast("int"))
    return found.select(*key, "short_name", "long_name", F.explode(times).alias("time")).drop("time")


@query("j11_least_greatest_pairs", "WITH p AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS entity_a, greatest(l_suppkey, l_partkey % 100) AS entity_b, l_orderkey FROM lineitem) SELECT entity_a, entity_b, count(*) AS articles FROM p GROUP BY 1, 2 HAVING count(*) >= 3")
def j11(m: Model) -> DataFrame:
    pairs = m.table("lineitem").selectExpr("l_suppkey AS x", "l_partkey % 100 AS y", "l_orderkey").selectExpr(*PAIR, "l_orderkey").distinct()
    return pairs.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("articles")).where("articles >= 3")


@query("j12_scalar_count", over("articles facts", "SELECT id, (SELECT count(*) FROM facts f WHERE f.article_id = a.id) AS fact_count FROM articles a WHERE published_date >= TIMESTAMP '2001-07-01'"))
def j12(m: Model) -> DataFrame:
    counted = m.facts.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return m.articles.where("published_date >= TIMESTAMP_NTZ'2001-07-01'").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("fact_count"))


@query("j14_edges_within_nodes", over("facts", "SELECT a.article_id, a.entity AS source, b.entity AS target FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity WHERE a.entity IN (SELECT entity FROM n) AND b.entity IN (SELECT entity FROM n)", "n AS (SELECT entity FROM facts GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 200)"))
def j14(m: Model) -> DataFrame:
    nodes = m.facts.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(200)
    edges = entity_pairs(m.facts.join(nodes, "entity", "left_semi"))  # both endpoints are filtered before the pairs are made
    return edges.selectExpr("article_id", "entity_a AS source", "entity_b AS target")


def co_mentions(facts: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """Other entities in the articles that hold the focal one."""
    there = facts.where(F.col("entity") == entity).select("article_id")
    found = facts.where(F.col("entity") != entity).join(there, "article_id", "left_semi").groupBy("entity", "entity_type")
    return found.agg(F.count_distinct("article_id").alias("articles"), F.round(F.avg("confidence"), 6).alias("confidence")).orderBy(F.desc("articles"), "entity", "entity_type").limit(limit)


@query("j15_co_mentions", over("facts", "SELECT entity, entity_type, count(DISTINCT article_id) AS articles, round(avg(confidence), 6) AS confidence FROM facts WHERE entity <> 'E0000007' AND article_id IN (SELECT article_id FROM facts WHERE entity = 'E0000007') GROUP BY 1, 2 ORDER BY articles DESC, entity, entity_type LIMIT 50"))
def j15(m: Model) -> DataFrame:
    return co_mentions(m.facts, "E0000007")


@query("w01_status_share", over("articles", "SELECT processing_status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM articles GROUP BY 1"))
def w01(m: Model) -> DataFrame:
    counted = m.articles.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()), 2))


@query("w06_distinct_on", over("facts", "SELECT article_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY confidence DESC, entity) AS k FROM facts) WHERE k = 1"))
def w06(m: Model) -> DataFrame:
    # max_by combines before the shuffle, where a ranking window would not.
    best = F.max_by(F.col("entity"), F.struct(F.col("confidence"), (-F.substring("entity", 2, 7).cast("long")).alias("k")))
    return m.facts.groupBy("article_id").agg(best.alias("entity"))


@query("w07_min_max_scale", over("facts", "SELECT entity, round(CASE WHEN hi > lo THEN 0.3 + 0.7 * (n - lo) / CAST(hi - lo AS DOUBLE) ELSE 0.65 END, 6) AS scaled FROM (SELECT entity, n, min(n) OVER () AS lo, max(n) OVER () AS hi FROM (SELECT entity, count(*) AS n FROM facts GROUP BY entity))"))
def w07(m: Model) -> DataFrame:
    return min_max(m.facts.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "n").select("entity", F.round("scaled", 6).alias("scaled"))


def min_max(df: DataFrame, column: str, low: float = 0.3, high: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``scaled``: the column brought to [low, high]; the middle where all are equal.  Bounds come from an aggregate, not from one task."""
    bounds = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = df.join(bounds, list(keys)) if keys else df.crossJoin(F.broadcast(bounds))
    share = F.try_divide((F.col(column) - F.col("_lo")).cast("double"), F.col("_hi") - F.col("_lo"))
    return joined.withColumn("scaled", F.coalesce(low + (high - low) * share, F.lit((low + high) / 2))).drop("_lo", "_hi")


@query("w08_top_nodes", over("facts", "SELECT entity, count(*) AS degree FROM facts GROUP BY entity ORDER BY degree DESC, entity LIMIT 10"))
def w08(m: Model) -> DataFrame:
    return m.facts.groupBy("entity").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "entity").limit(10)


@query("w09_latest_per_key", over("articles", "SELECT source, max(published_date) AS latest, count(*) AS articles FROM articles WHERE published_date = (SELECT max(published_date) FROM articles) GROUP BY source"))
def w09(m: Model) -> DataFrame:
    latest = m.articles.agg(F.max("published_date").alias("latest"))
    return m.articles.crossJoin(F.broadcast(latest)).where("published_date = latest").groupBy("source").agg(F.max("latest").alias("latest"), F.count(F.lit(1)).alias("articles"))


@query("o01_page", over("articles", "SELECT id, title FROM articles ORDER BY published_date DESC NULLS FIRST, id LIMIT 20 OFFSET 40"))
def o01(m: Model) -> DataFrame:
    return m.articles.orderBy(F.desc_nulls_first("published_date"), "id").offset(40).limit(20).select("id", "title")


@query("o02_nulls_first", over("articles", "SELECT id, processed_date FROM articles WHERE id % 50 = 0 OR processed_date IS NOT NULL ORDER BY processed_date DESC NULLS FIRST, id LIMIT 1000"))
def o02(m: Model) -> DataFrame:
    # Few enough nulls that the page reaches into the dates.
    some = m.articles.where("id % 50 = 0 OR processed_date IS NOT NULL")
    return some.orderBy(F.desc_nulls_first("processed_date"), "id").limit(1000).select("id", "processed_date")


@query("o03_most_entities", over("articles facts", "SELECT id, count(DISTINCT entity) AS entities FROM articles JOIN facts ON article_id = id GROUP BY id ORDER BY entities DESC, id LIMIT 25"))
def o03(m: Model) -> DataFrame:
    # The model's facts always belong to an article, so the count needs no join.
    counted = m.facts.groupBy(F.col("article_id").alias("id")).agg(F.count_distinct("entity").alias("entities"))
    return counted.orderBy(F.desc("entities"), "id").limit(25)


@query("u01_union_distinct", over("facts", "SELECT entity FROM facts WHERE confidence >= 0.95 UNION SELECT entity FROM facts WHERE entity_type LIKE 'PROMO%' UNION SELECT entity FROM facts WHERE sentence_index = 6"))
def u01(m: Model) -> DataFrame:
    sets = [m.facts.where(c).select("entity") for c in ("confidence >= 0.95D", "entity_type LIKE 'PROMO%'", "sentence_index = 6")]
    return sets[0].union(sets[1]).union(sets[2]).distinct()


@query("u02_metric_rows", over("articles facts", "SELECT 'articles' AS metric, CAST(count(*) AS VARCHAR) AS value FROM articles UNION ALL SELECT 'facts', CAST(count(*) AS VARCHAR) FROM facts UNION ALL SELECT 'pending', CAST(count(*) AS VARCHAR) FROM articles WHERE processing_status = 'pending'"))
def u02(m: Model) -> DataFrame:
    row = lambda name, df: df.agg(F.lit(name).alias("metric"), F.count(F.lit(1)).cast("string").alias("value"))
    return row("articles", m.articles).unionByName(row("facts", m.facts)).unionByName(row("pending", m.articles.where("processing_status = 'pending'")))


@query("u03_distinct", over("facts", "SELECT DISTINCT entity_type, sentence_index FROM facts"))
def u03(m: Model) -> DataFrame:
    return m.facts.select("entity_type", "sentence_index").distinct()


@query("u04_set_operations", over("facts", "SELECT article_id, count(*) FILTER (WHERE a AND b) AS agreed, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b FROM (SELECT article_id, confidence >= 0.5 AS a, sentence_index <= 2 AS b FROM facts) WHERE a OR b GROUP BY article_id"))
def u04(m: Model) -> DataFrame:
    a, b = (F.collect_set(F.when(c, F.col("entity"))) for c in (F.expr("confidence >= 0.5D"), F.expr("sentence_index <= 2")))
    sets = m.facts.groupBy("article_id").agg(a.alias("a"), b.alias("b")).where("size(a) + size(b) > 0")
    n = lambda c: F.size(c).cast("long")
    return sets.select("article_id", n(F.array_intersect("a", "b")).alias("agreed"), n(F.array_except("a", "b")).alias("only_a"), n(F.array_except("b", "a")).alias("only_b"))
