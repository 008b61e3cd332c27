"""Aggregations over articles, facts, relations, topics and costs.  Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.proxy import AS_OF, Model, over
from ..plans.registry import query


def ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def days_before(as_of: str, days: int) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {days} DAY")


def status_counts(articles: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("processing_status") == s)
    return articles.agg(
        F.count(F.lit(1)).alias("total"), one("completed").alias("completed"), one("pending").alias("pending"), one("failed").alias("failed"), F.count_distinct("source").alias("sources")
    )


@query("a01_status_counts", over("articles", "SELECT count(*) AS total, count(*) FILTER (WHERE processing_status = 'completed') AS completed, count(*) FILTER (WHERE processing_status = 'pending') AS pending, count(*) FILTER (WHERE processing_status = 'failed') AS failed, count(DISTINCT source) AS sources FROM articles"))
def a01(m: Model) -> DataFrame:
    return status_counts(m.articles)


@query("a02_fact_totals", over("facts", "SELECT count(*) AS facts, round(avg(confidence), 6) AS avg_confidence FROM facts"))
def a02(m: Model) -> DataFrame:
    return m.facts.agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def spend(costs: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Cost of the month and of the day of ``as_of``, zero where there is none."""
    now = ts(as_of)
    month = F.col("timestamp") >= F.date_trunc("month", now).cast("timestamp_ntz")
    day = F.to_date("timestamp") == F.to_date(now)
    total = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("cost"))), F.lit(0.0)), 4)
    return costs.where(F.col("timestamp") <= now).agg(total(month).alias("month_to_date"), total(day).alias("today"), total(F.lit(True)).alias("all_time"))


@query("a03_spend", over("costs", "SELECT round(coalesce(sum(cost) FILTER (WHERE timestamp >= date_trunc('month', TIMESTAMP '2001-07-20')), 0.0), 4) AS month_to_date, round(coalesce(sum(cost) FILTER (WHERE CAST(timestamp AS DATE) = DATE '2001-07-20'), 0.0), 4) AS today, round(coalesce(sum(cost), 0.0), 4) AS all_time FROM costs WHERE timestamp <= TIMESTAMP '2001-07-20'"))
def a03(m: Model) -> DataFrame:
    return spend(m.costs, "2001-07-20 00:00:00")


def entity_type_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity_type").agg(F.count_distinct("entity").alias("entities"))


@query("a04_entity_types", over("facts", "SELECT entity_type, count(DISTINCT entity) AS entities FROM facts GROUP BY entity_type"))
def a04(m: Model) -> DataFrame:
    return entity_type_counts(m.facts)


def type_rollup(by_type: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """One row of sums over groups of entity types."""
    return by_type.agg(*[F.coalesce(F.sum(F.when(F.col("entity_type").isin(*types), F.col("entities"))), F.lit(0)).alias(name) for name, types in groups.items()])


#: The types that each headline count sums.
TYPE_GROUPS = {"people": ["PERSON"], "locations": ["LOCATION", "GPE", "LOC"], "organizations": ["ORGANIZATION", "ORG"], "events": ["EVENT"]}


@query("a04b_type_rollup", over("facts", "SELECT CAST(coalesce(sum(n) FILTER (WHERE g = 'STANDARD'), 0) AS BIGINT) AS people, CAST(coalesce(sum(n) FILTER (WHERE g IN ('SMALL', 'MEDIUM', 'LARGE')), 0) AS BIGINT) AS locations, CAST(coalesce(sum(n) FILTER (WHERE g IN ('ECONOMY', 'PROMO')), 0) AS BIGINT) AS organizations, CAST(coalesce(sum(n) FILTER (WHERE g = 'EVENT'), 0) AS BIGINT) AS events FROM t", "t AS (SELECT split_part(entity_type, ' ', 1) AS g, count(DISTINCT entity) AS n FROM facts GROUP BY 1)"))
def a04b(m: Model) -> DataFrame:
    by_type = entity_type_counts(m.facts.withColumn("entity_type", F.split("entity_type", " ")[0]))
    proxy = {"people": ["STANDARD"], "locations": ["SMALL", "MEDIUM", "LARGE"], "organizations": ["ECONOMY", "PROMO"], "events": ["EVENT"]}
    return type_rollup(by_type, proxy)


def entity_mentions(facts: DataFrame, min_mentions: int = 1, limit: int | None = None) -> DataFrame:
    """Entities with at least ``min_mentions`` facts, most mentioned first."""
    counted = facts.groupBy("entity", "entity_type").agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    ordered = counted.where(F.col("mentions") >= min_mentions).orderBy(F.desc("mentions"), "entity", "entity_type")
    return ordered.limit(limit) if limit else ordered


@query("a05_entity_mentions", over("facts", "SELECT entity, entity_type, count(*) AS mentions, round(avg(confidence), 6) AS avg_confidence FROM facts GROUP BY entity, entity_type HAVING count(*) >= 2 ORDER BY mentions DESC, entity, entity_type LIMIT 100"))
def a05(m: Model) -> DataFrame:
    return entity_mentions(m.facts, 2, 100)


@query("a08_provider_costs", over("costs", "SELECT api_provider, count(*) AS calls, round(sum(cost), 4) AS total_cost FROM costs GROUP BY api_provider"))
def a08(m: Model) -> DataFrame:
    return m.costs.groupBy("api_provider").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 4).alias("total_cost"))


@query("a08b_source_counts", over("articles", "SELECT source, count(*) AS articles FROM articles WHERE processing_status = 'completed' GROUP BY source"))
def a08b(m: Model) -> DataFrame:
    return m.articles.where("processing_status = 'completed'").groupBy("source").agg(F.count(F.lit(1)).alias("articles"))


def feed_stats(status: DataFrame) -> DataFrame:
    """Totals over feed states (feed_url, error_count, total, last_success)."""
    return status.agg(
        F.count(F.lit(1)).alias("feeds"), F.count_if(F.col("error_count") == 0).alias("healthy"), F.count_if(F.col("error_count") > 0).alias("failing"), F.sum("total").alias("collected"), F.max("last_success").alias("last_success")
    )


_FEEDS = "f AS (SELECT event_type AS feed_url, count(*) FILTER (WHERE value < 10) AS error_count, count(*) AS total, max(ts) AS last_success FROM events GROUP BY event_type)"


@query("a13_feed_stats", f"WITH {_FEEDS} SELECT count(*) AS feeds, count(*) FILTER (WHERE error_count = 0) AS healthy, count(*) FILTER (WHERE error_count > 0) AS failing, CAST(sum(total) AS BIGINT) AS collected, max(last_success) AS last_success FROM f")
def a13(m: Model) -> DataFrame:
    feeds = m.table("events").groupBy(F.col("event_type").alias("feed_url")).agg(F.count_if(F.col("value") < 10).alias("error_count"), F.count(F.lit(1)).alias("total"), F.max("ts").alias("last_success"))
    return feed_stats(feeds)


@query("a14_entity_importance", over("facts", "SELECT entity, count(DISTINCT article_id) AS articles FROM facts WHERE confidence >= 0.6 GROUP BY entity"))
def a14(m: Model) -> DataFrame:
    return m.facts.where("confidence >= 0.6D").groupBy("entity").agg(F.count_distinct("article_id").alias("articles"))


@query("a14b_article_density", over("facts", "SELECT article_id, count(DISTINCT entity) AS entities FROM facts WHERE confidence >= 0.6 GROUP BY article_id"))
def a14b(m: Model) -> DataFrame:
    return m.facts.where("confidence >= 0.6D").groupBy("article_id").agg(F.count_distinct("entity").alias("entities"))


def entity_coherence(facts: DataFrame) -> DataFrame:
    """Per article: distinct names, keys of name and type that repeat, names under several types."""
    named = facts.select("article_id", F.lower("entity").alias("name"), F.lower("entity_type").alias("type"))
    keys = named.groupBy("article_id", "name", "type").agg(F.count(F.lit(1)).alias("n"))
    names = keys.groupBy("article_id", "name").agg(F.count(F.lit(1)).alias("types"), F.count_if(F.col("n") > 1).alias("repeated"))
    return names.groupBy("article_id").agg(F.count(F.lit(1)).alias("unique_entities"), F.sum("repeated").alias("duplicate_keys"), F.count_if(F.col("types") > 1).alias("type_conflicts"))


@query("a20_entity_coherence", "WITH n AS (SELECT l_orderkey AS article_id, lower(p_brand) AS name, lower(split_part(p_type, ' ', 1)) AS type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3), k AS (SELECT article_id, name, count(*) AS types, count(*) FILTER (WHERE n > 1) AS repeated FROM n GROUP BY 1, 2) SELECT article_id, count(*) AS unique_entities, CAST(sum(repeated) AS BIGINT) AS duplicate_keys, count(*) FILTER (WHERE types > 1) AS type_conflicts FROM k GROUP BY article_id")
def a20(m: Model) -> DataFrame:
    branded = m.table("lineitem").join(m.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    return entity_coherence(branded.select(F.col("l_orderkey").alias("article_id"), F.col("p_brand").alias("entity"), F.split("p_type", " ")[0].alias("entity_type")))


def article_rollup(facts: DataFrame, high: float = 0.8) -> DataFrame:
    return facts.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("fact_count"), F.count_if(F.col("confidence") >= high).alias("high_confidence"), F.count("wikidata_id").alias("enriched"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


@query("a21_article_rollup", over("facts", "SELECT article_id, count(*) AS fact_count, count(*) FILTER (WHERE confidence >= 0.8) AS high_confidence, count(wikidata_id) AS enriched, round(avg(confidence), 6) AS mean_confidence FROM facts GROUP BY article_id"))
def a21(m: Model) -> DataFrame:
    return article_rollup(m.facts)


def precision_recall(predicted: DataFrame, truth: DataFrame, key: str = "article_id") -> DataFrame:
    """Per key precision, recall and F1 of two sets of lower-cased entities; zero where a denominator is."""
    p = predicted.select(key, F.lower("entity").alias("e")).distinct().withColumn("p", F.lit(1))
    t = truth.select(key, F.lower("entity").alias("e")).distinct().withColumn("t", F.lit(1))
    counts = p.join(t, [key, "e"], "full").groupBy(key).agg(F.count(F.expr("CASE WHEN p = 1 AND t = 1 THEN 1 END")).alias("agreed"), F.count("p").alias("n_p"), F.count("t").alias("n_t"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = counts.withColumns({"precision": ratio(F.col("agreed"), F.col("n_p")), "recall": ratio(F.col("agreed"), F.col("n_t"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select(key, "agreed", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query("a22_precision_recall", over("facts", "SELECT article_id, agreed, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM q", "c AS (SELECT article_id, count(*) FILTER (WHERE confidence >= 0.5 AND sentence_index <= 3) AS agreed, count(*) FILTER (WHERE confidence >= 0.5) AS np, count(*) FILTER (WHERE sentence_index <= 3) AS nt FROM facts WHERE confidence >= 0.5 OR sentence_index <= 3 GROUP BY article_id)", "q AS (SELECT article_id, agreed, CASE WHEN np > 0 THEN agreed / CAST(np AS DOUBLE) ELSE 0.0 END AS p, CASE WHEN nt > 0 THEN agreed / CAST(nt AS DOUBLE) ELSE 0.0 END AS r FROM c)"))
def a22(m: Model) -> DataFrame:
    return precision_recall(m.facts.where("confidence >= 0.5D"), m.facts.where("sentence_index <= 3"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays taken as sets; two empty ones overlap by 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


@query("a23_jaccard_overlap", over("facts", "SELECT article_id, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE a AND b) / CAST(count(*) AS DOUBLE) ELSE 0.0 END, 6) AS overlap FROM (SELECT article_id, list_contains(source_models, 'A') AS a, list_contains(source_models, 'N') AS b FROM facts) WHERE a OR b GROUP BY article_id"))
def a23(m: Model) -> DataFrame:
    by = m.facts.where("array_contains(source_models, 'A') OR array_contains(source_models, 'N')").groupBy("article_id")
    sets = by.agg(F.collect_set(F.when(F.array_contains("source_models", "A"), F.col("entity"))).alias("a"), F.collect_set(F.when(F.array_contains("source_models", "N"), F.col("entity"))).alias("b"))
    return sets.select("article_id", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


def throughput(articles: DataFrame, as_of: str = AS_OF, parallel: int = 10) -> DataFrame:
    """Completions of the last day, mean seconds of processing over seven days, and hours to clear the backlog."""
    day = F.count_if((F.col("processing_status") == "completed") & (F.col("processed_date") >= days_before(as_of, 1)) & (F.col("processed_date") <= ts(as_of)))
    seconds = F.unix_timestamp(F.col("processed_date").cast("timestamp")) - F.unix_timestamp(F.col("collected_date").cast("timestamp"))
    mean = F.avg(F.when((F.col("processing_status") == "completed") & (F.col("processed_date") >= days_before(as_of, 7)), seconds))
    pending = F.count_if(F.col("processing_status") == "pending")
    base = articles.agg(day.alias("completed_24h"), F.round(mean, 3).alias("avg_seconds"), pending.alias("pending"))
    hours = F.col("pending") * F.col("avg_seconds") / 3600
    return base.withColumns({"eta_hours": F.round(hours, 3), "eta_hours_parallel": F.round(hours / parallel, 3)})


@query("a26_throughput", over("articles", "SELECT *, round(pending * avg_seconds / 3600, 3) AS eta_hours, round(pending * avg_seconds / 3600 / 10, 3) AS eta_hours_parallel FROM b", "b AS (SELECT count(*) FILTER (WHERE processing_status = 'completed' AND processed_date >= TIMESTAMP '1995-06-30' AND processed_date <= TIMESTAMP '1995-07-01') AS completed_24h, round(avg(epoch(processed_date) - epoch(collected_date)) FILTER (WHERE processing_status = 'completed' AND processed_date >= TIMESTAMP '1995-06-24'), 3) AS avg_seconds, count(*) FILTER (WHERE processing_status = 'pending') AS pending FROM articles)"))
def a26(m: Model) -> DataFrame:
    return throughput(m.articles, "1995-07-01 00:00:00")


@query("a27_popular_entities", over("facts", "SELECT entity, count(*) AS mentions, arg_max(entity_type, article_id) AS last_type FROM facts GROUP BY entity ORDER BY mentions DESC, entity LIMIT 8"))
def a27(m: Model) -> DataFrame:
    counted = m.facts.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"), F.max_by("entity_type", "article_id").alias("last_type"))
    return counted.orderBy(F.desc("mentions"), "entity").limit(8)


def facts_by_article(facts: DataFrame) -> DataFrame:
    """The facts of an article as a list, most confident first."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "entity", "entity_type")))
    return facts.groupBy("article_id").agg(listed.alias("l")).select("article_id", F.transform("l", lambda x: F.struct(x["entity"].alias("entity"), x["entity_type"].alias("entity_type"), (-x["c"]).alias("confidence"))).alias("facts"))


@query("a28_facts_by_article", over("facts", "SELECT article_id, count(*) AS n, string_agg(entity, ',' ORDER BY confidence DESC, entity) AS entities FROM facts GROUP BY article_id"))
def a28(m: Model) -> DataFrame:
    return facts_by_article(m.facts).select("article_id", F.size("facts").cast("long").alias("n"), F.array_join("facts.entity", ",").alias("entities"))


@query("a29_source_status_pivot", over("articles", "SELECT source, count(*) FILTER (WHERE processing_status = 'completed') AS completed, count(*) FILTER (WHERE processing_status = 'failed') AS failed, count(*) FILTER (WHERE processing_status = 'pending') AS pending FROM articles GROUP BY source"))
def a29(m: Model) -> DataFrame:
    return m.articles.groupBy("source").pivot("processing_status", ["completed", "failed", "pending"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a33_position_coverage", over("facts", "SELECT count(*) AS facts, count(nullif(sentence_index, 0)) AS positioned FROM facts"))
def a33(m: Model) -> DataFrame:
    return m.facts.agg(F.count(F.lit(1)).alias("facts"), F.count(F.nullif("sentence_index", F.lit(0))).alias("positioned"))


@query("a37_recent_by_source", over("articles", "SELECT source, count(*) AS articles, max(collected_date) AS latest FROM articles WHERE collected_date >= TIMESTAMP '2001-07-31' GROUP BY source"))
def a37(m: Model) -> DataFrame:
    recent = m.articles.where(F.col("collected_date") >= days_before(AS_OF, 1))
    return recent.groupBy("source").agg(F.count(F.lit(1)).alias("articles"), F.max("collected_date").alias("latest"))


@query("a38_duplicate_urls", "SELECT url, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT 'https://news.example/' || o_custkey FROM orders) GROUP BY url HAVING count(*) > 1")
def a38(m: Model) -> DataFrame:
    ordered = m.table("orders").select(F.concat(F.lit("https://news.example/"), F.col("o_custkey").cast("string")).alias("url"))
    return m.table("pages").select("url").unionByName(ordered).groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a39_positioned_articles", over("articles facts", "SELECT a.id, a.title, a.published_date, count(*) AS facts FROM articles a JOIN facts f ON f.article_id = a.id GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 7 AND 30"))
def a39(m: Model) -> DataFrame:
    counted = m.facts.groupBy("article_id").agg(F.count(F.lit(1)).alias("facts")).where("facts BETWEEN 7 AND 30")
    return m.articles.join(counted, F.col("id") == F.col("article_id")).select("id", "title", "published_date", "facts")
