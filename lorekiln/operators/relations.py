"""Entity relationships: sentence proximity, pointwise mutual information, support across articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import distance_weight, edge_strength, pmi_columns
from ..plans.proxy import AS_OF, Model, over
from ..plans.registry import query
from .relational import dealt, entity_pairs

SMOOTHING = 1e-6


def windowed_pairs(mentions: DataFrame, window: int = 2) -> DataFrame:
    """Mentions a < b of one article within ``window`` sentences.

    An article's sentences are cut into blocks of the window's width; the join is on article and block, to
    which one side goes with its neighbours, so that work grows with the mentions within reach and not
    with the square of an article's mentions.
    """
    width = max(1, window)
    a = mentions.select("article_id", F.col("entity").alias("entity_a"), F.col("sentence_index").alias("si"), F.col("confidence").alias("confidence_a"))
    b = mentions.select("article_id", F.col("entity").alias("entity_b"), F.col("sentence_index").alias("sj"), F.col("confidence").alias("confidence_b"))
    a = a.withColumn("block", F.floor(F.col("si") / width))
    b = b.withColumn("block", F.explode(F.sequence(F.floor(F.col("sj") / width) - 1, F.floor(F.col("sj") / width) + 1)))
    joined = a.join(b, ["article_id", "block"]).where(F.expr(f"entity_a < entity_b AND abs(si - sj) <= {window}"))
    return joined.withColumn("distance", F.abs(F.col("si") - F.col("sj"))).drop("si", "sj", "block")


@query("j08_band_join", over("mentions", "SELECT a.article_id, a.entity AS entity_a, b.entity AS entity_b, abs(a.sentence_index - b.sentence_index) AS distance, count(*) AS n FROM mentions a JOIN mentions b ON a.article_id = b.article_id AND a.entity < b.entity AND abs(a.sentence_index - b.sentence_index) <= 1 GROUP BY 1, 2, 3, 4"))
def j08(m: Model) -> DataFrame:
    return windowed_pairs(m.mentions, 1).groupBy("article_id", "entity_a", "entity_b", "distance").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence_matrix(mentions: DataFrame, window: int = 2) -> DataFrame:
    """Weights and distances of each pair of an article.

    The surveyed system visits a pair from both ends, so weights and counts are doubled and both
    confidences are the mean over both ends.
    """
    d = F.col("distance")
    count = lambda c: (2 * F.count_if(c)).alias
    return (
        windowed_pairs(mentions, window)
        .groupBy("article_id", "entity_a", "entity_b")
        .agg(
            (2 * F.sum(distance_weight(d))).alias("total_weight"),
            F.min(d).alias("min_distance"),
            F.max(d).alias("max_distance"),
            F.avg(d).alias("avg_distance"),
            count(d == 0)("same_sentence"),
            count(d == 1)("adjacent_sentence"),
            count(d > 1)("near_proximity"),
            F.avg((F.col("confidence_a") + F.col("confidence_b")) / 2).alias("confidence"),
        )
    )


_MATRIX = """matrix AS (SELECT article_id, entity_a, entity_b, 2 * sum(CASE d WHEN 0 THEN CAST(3 AS DOUBLE) WHEN 1 THEN 2 ELSE 1 END) AS total_weight, min(d) AS min_distance, max(d) AS max_distance, avg(d) AS avg_distance,
  2 * count(*) FILTER (WHERE d = 0) AS same_sentence, 2 * count(*) FILTER (WHERE d = 1) AS adjacent_sentence, 2 * count(*) FILTER (WHERE d > 1) AS near_proximity, avg(c) AS confidence
  FROM (SELECT a.article_id, a.entity AS entity_a, b.entity AS entity_b, abs(a.sentence_index - b.sentence_index) AS d, (a.confidence + b.confidence) / 2 AS c FROM mentions a JOIN mentions b ON a.article_id = b.article_id AND a.entity < b.entity AND abs(a.sentence_index - b.sentence_index) <= 2) GROUP BY 1, 2, 3)"""


@query("a17_cooccurrence_matrix", over("mentions", "SELECT article_id, entity_a, entity_b, total_weight, min_distance, max_distance, round(avg_distance, 6) AS avg_distance, same_sentence, adjacent_sentence, near_proximity, round(confidence, 6) AS confidence FROM matrix", _MATRIX))
def a17(m: Model) -> DataFrame:
    return cooccurrence_matrix(m.mentions).withColumns({"avg_distance": F.round("avg_distance", 6), "confidence": F.round("confidence", 6)})


@query("f22_matrix_weight_filter", over("mentions", "SELECT article_id, entity_a, entity_b, total_weight FROM matrix WHERE total_weight >= 6", _MATRIX))
def f22(m: Model) -> DataFrame:
    return cooccurrence_matrix(m.mentions).where("total_weight >= 6").select("article_id", "entity_a", "entity_b", "total_weight")


@query("f22b_matrix_weight_default", over("mentions", "SELECT article_id, count(*) AS pairs FROM matrix WHERE total_weight >= 2.0 GROUP BY 1", _MATRIX))
def f22b(m: Model) -> DataFrame:
    return cooccurrence_matrix(m.mentions).where("total_weight >= 2.0D").groupBy("article_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("a18_sentence_frequency", over("mentions", "SELECT article_id, entity, count(DISTINCT sentence_index) AS sentences FROM mentions GROUP BY 1, 2"))
def a18(m: Model) -> DataFrame:
    return sentence_frequency(m.mentions)


def sentence_frequency(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("article_id", "entity").agg(F.count_distinct("sentence_index").alias("sentences"))


def by_entity(facts: DataFrame) -> DataFrame:
    """(article_id, entity, confidence): facts are unique by article, entity and type; of an entity's types in an article the surest counts.

    Dealt out by article, so that pairs inside an article need no other shuffle and their number in a task is bounded.
    """
    return dealt(facts.select("article_id", "entity", "confidence")).groupBy("article_id", "entity").agg(F.max("confidence").alias("confidence"))


def document_frequency(facts: DataFrame) -> DataFrame:
    """Articles of each entity, and the number of all articles."""
    facts = facts.select("article_id", "entity").distinct()
    total = facts.agg(F.count_distinct("article_id").alias("n_articles"))
    return facts.groupBy("entity").agg(F.count(F.lit(1)).alias("articles")).crossJoin(F.broadcast(total))


@query("a18b_document_frequency", over("facts", "SELECT entity, count(DISTINCT article_id) AS articles, (SELECT count(DISTINCT article_id) FROM facts) AS n_articles FROM facts GROUP BY entity"))
def a18b(m: Model) -> DataFrame:
    return document_frequency(m.facts)


@query("a19_matrix_stats", over("mentions", "SELECT count(*) AS pairs, coalesce(max(total_weight), 0) AS max_weight, coalesce(min(total_weight), 0) AS min_weight, coalesce(round(avg(total_weight), 6), 0) AS avg_weight, CAST(coalesce(sum(same_sentence), 0) AS BIGINT) AS same_sentence FROM matrix", _MATRIX))
def a19(m: Model) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return cooccurrence_matrix(m.mentions).agg(
        F.count(F.lit(1)).alias("pairs"), zero(F.max("total_weight")).alias("max_weight"), zero(F.min("total_weight")).alias("min_weight"), zero(F.round(F.avg("total_weight"), 6)).alias("avg_weight"), zero(F.sum("same_sentence")).alias("same_sentence")
    )


def corpus_pmi(facts: DataFrame, min_count: int = 2) -> DataFrame:
    """PMI and NPMI of entity pairs by articles."""
    known = by_entity(facts)
    pairs = entity_pairs(known).groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("n_ab"), F.avg((F.col("confidence_a") + F.col("confidence_b")) / 2).alias("confidence"))
    freq = document_frequency(known)
    a = freq.select(F.col("entity").alias("entity_a"), F.col("articles").alias("n_a"), F.col("n_articles").alias("n"))
    b = freq.select(F.col("entity").alias("entity_b"), F.col("articles").alias("n_b"))
    joined = pairs.where(F.col("n_ab") >= min_count).join(a, "entity_a").join(b, "entity_b")
    return joined.withColumns(pmi_columns(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n"), SMOOTHING))


_PMI = """d AS (SELECT entity, count(DISTINCT article_id) AS c FROM facts GROUP BY entity), t AS (SELECT CAST(count(DISTINCT article_id) AS DOUBLE) AS n FROM facts),
pairs AS (SELECT a.entity AS entity_a, b.entity AS entity_b, count(DISTINCT a.article_id) AS n_ab, avg((a.confidence + b.confidence) / 2) AS confidence FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(DISTINCT a.article_id) >= 2),
p AS (SELECT entity_a, entity_b, n_ab, confidence, (n_ab + 1e-6) / (n + 1e-6) AS pxy, (x.c + 1e-6) / (n + 1e-6) AS px, (y.c + 1e-6) / (n + 1e-6) AS py FROM pairs JOIN d x ON x.entity = entity_a JOIN d y ON y.entity = entity_b CROSS JOIN t),
scored AS (SELECT *, ln(pxy / (px * py + 1e-6) + 1e-6) AS pmi FROM p), s2 AS (SELECT *, pmi / (-ln(pxy + 1e-6) + 1e-6) AS npmi FROM scored)"""


@query("m01_corpus_pmi", over("facts", "SELECT entity_a, entity_b, n_ab, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(pmi * confidence, 6) AS score FROM s2", _PMI))
def m01(m: Model) -> DataFrame:
    scored = corpus_pmi(m.facts)
    return scored.select("entity_a", "entity_b", "n_ab", F.round("pmi", 6).alias("pmi"), F.round("npmi", 6).alias("npmi"), F.round(F.col("pmi") * F.col("confidence"), 6).alias("score"))


@query("a19b_pmi_stats", over("facts", "SELECT count(*) AS pairs, coalesce(round(min(npmi), 6), 0) AS min_npmi, coalesce(round(max(npmi), 6), 0) AS max_npmi, coalesce(round(avg(npmi), 6), 0) AS avg_npmi, count(*) FILTER (WHERE n_ab < 3) AS rare FROM s2", _PMI))
def a19b(m: Model) -> DataFrame:
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0))
    return corpus_pmi(m.facts).agg(
        F.count(F.lit(1)).alias("pairs"), zero(F.min("npmi")).alias("min_npmi"), zero(F.max("npmi")).alias("max_npmi"), zero(F.avg("npmi")).alias("avg_npmi"), F.count_if(F.col("n_ab") < 3).alias("rare")
    )


@query("f23_pmi_threshold", over("facts", "SELECT entity_a, entity_b, round(npmi, 6) AS npmi FROM s2 WHERE CASE WHEN n_ab < 3 THEN pmi * confidence > 0 ELSE npmi >= 0.5 END", _PMI))
def f23(m: Model) -> DataFrame:
    kept = corpus_pmi(m.facts).where(F.when(F.col("n_ab") < 3, F.col("pmi") * F.col("confidence") > 0).otherwise(F.col("npmi") >= 0.5))
    return kept.select("entity_a", "entity_b", F.round("npmi", 6).alias("npmi"))


def article_relations(mentions: DataFrame, window: int = 2, min_frequency: int = 2) -> DataFrame:
    """The per-article pipeline up to scored edges: matrix, sentence frequencies, PMI or proximity for rare entities."""
    matrix = cooccurrence_matrix(mentions, window)
    freq = sentence_frequency(mentions)
    total = mentions.groupBy("article_id").agg(F.count_distinct("sentence_index").alias("n"))
    a = freq.select("article_id", F.col("entity").alias("entity_a"), F.col("sentences").alias("n_a"))
    b = freq.select("article_id", F.col("entity").alias("entity_b"), F.col("sentences").alias("n_b"))
    joined = matrix.join(a, ["article_id", "entity_a"]).join(b, ["article_id", "entity_b"]).join(total, "article_id")
    # As in the surveyed system the doubled weight stands in for the count of joint sentences.
    joined = joined.withColumns(pmi_columns(F.col("total_weight"), F.col("n_a"), F.col("n_b"), F.col("n"), SMOOTHING))
    rare = (F.col("n_a") < min_frequency) | (F.col("n_b") < min_frequency)
    return joined.withColumns(
        {
            "is_rare": rare,
            "npmi": F.when(rare, F.lit(0.0)).otherwise(F.col("npmi")),
            "pmi": F.when(rare, F.lit(0.0)).otherwise(F.col("pmi")),
            "pmi_score": F.when(rare, F.col("total_weight") * F.col("confidence")).otherwise(F.col("pmi") * F.col("confidence")),
            "score": F.when(rare, F.least(F.lit(1.0), F.col("total_weight") * F.col("confidence") / 10)).otherwise(F.col("npmi")),
        }
    )


@query("g14_article_relations", over("mentions", "SELECT m.article_id, entity_a, entity_b, total_weight, x.s < 2 OR y.s < 2 AS is_rare, round(CASE WHEN x.s < 2 OR y.s < 2 THEN total_weight * confidence ELSE ln(((total_weight + 1e-6) / (n + 1e-6)) / (((x.s + 1e-6) / (n + 1e-6)) * ((y.s + 1e-6) / (n + 1e-6)) + 1e-6) + 1e-6) * confidence END, 6) AS pmi_score FROM matrix m JOIN f x ON x.article_id = m.article_id AND x.entity = entity_a JOIN f y ON y.article_id = m.article_id AND y.entity = entity_b JOIN t ON t.article_id = m.article_id", _MATRIX, "f AS (SELECT article_id, entity, count(DISTINCT sentence_index) AS s FROM mentions GROUP BY 1, 2)", "t AS (SELECT article_id, CAST(count(DISTINCT sentence_index) AS DOUBLE) AS n FROM mentions GROUP BY 1)"))
def g14(m: Model) -> DataFrame:
    return article_relations(m.mentions).select("article_id", "entity_a", "entity_b", "total_weight", "is_rare", F.round("pmi_score", 6).alias("pmi_score"))


def scored_edges(mentions: DataFrame, min_score: float = 0.0, types: list[str] | None = None) -> DataFrame:
    """An article's edges as its network shows them: the score is NPMI, of rare pairs proximity, and strength the score under confidence."""
    found = article_relations(mentions)
    score, strength = edge_strength(F.when(~F.col("is_rare"), F.col("npmi")), F.col("total_weight"), F.col("confidence"))
    raw = F.col("same_sentence") + F.col("adjacent_sentence") + F.col("near_proximity")
    edges = found.select("article_id", F.col("entity_a").alias("source"), F.col("entity_b").alias("target"), relation_type(F.col("min_distance")).alias("type"), score.alias("score"), strength.alias("strength"), "confidence", raw.alias("raw_count"))
    kept = edges.where(F.col("score") >= min_score)
    return kept if types is None else kept.where(F.col("type").isin(types))


@query("s29_scored_edges", over("mentions", """SELECT article_id, entity_a AS source, entity_b AS target, CASE min_distance WHEN 0 THEN 'same-sentence' WHEN 1 THEN 'adjacent-sentence' ELSE 'near-proximity' END AS type, round(score, 6) AS score, round(least(score * confidence, 1.0), 6) AS strength, raw_count
FROM (SELECT m.*, same_sentence + adjacent_sentence + near_proximity AS raw_count, CASE WHEN x.s < 2 OR y.s < 2 THEN least(1.0, total_weight / 10)
  ELSE ln(((total_weight + 1e-6) / (n + 1e-6)) / (((x.s + 1e-6) / (n + 1e-6)) * ((y.s + 1e-6) / (n + 1e-6)) + 1e-6) + 1e-6) / (-ln((total_weight + 1e-6) / (n + 1e-6) + 1e-6) + 1e-6) END AS score
  FROM matrix m JOIN f x ON x.article_id = m.article_id AND x.entity = entity_a JOIN f y ON y.article_id = m.article_id AND y.entity = entity_b JOIN t ON t.article_id = m.article_id) WHERE score >= 0.5""", _MATRIX, "f AS (SELECT article_id, entity, count(DISTINCT sentence_index) AS s FROM mentions GROUP BY 1, 2)", "t AS (SELECT article_id, CAST(count(DISTINCT sentence_index) AS DOUBLE) AS n FROM mentions GROUP BY 1)"))
def s29_scored_edges(m: Model) -> DataFrame:
    edges = scored_edges(m.mentions, 0.5)
    return edges.select("article_id", "source", "target", "type", F.round("score", 6).alias("score"), F.round("strength", 6).alias("strength"), "raw_count")


def pair_support(facts: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Distinct articles of each pair of confident entities."""
    pairs = entity_pairs(by_entity(facts.where(F.col("confidence") >= min_confidence)))
    return pairs.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("articles"))


_SUPPORT = "support AS (SELECT a.entity AS entity_a, b.entity AS entity_b, count(DISTINCT a.article_id) AS articles FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity WHERE a.confidence >= 0.6 AND b.confidence >= 0.6 GROUP BY 1, 2)"


@query("a15_pair_support", over("facts", "SELECT * FROM support WHERE articles >= 2", _SUPPORT))
def a15(m: Model) -> DataFrame:
    return pair_support(m.facts).where("articles >= 2")


@query("a15b_single_support", over("facts", "SELECT entity_a, entity_b FROM support WHERE articles = 1", _SUPPORT))
def a15b(m: Model) -> DataFrame:
    return pair_support(m.facts).where("articles = 1").select("entity_a", "entity_b")


def weighted_pairs(facts: DataFrame, min_articles: int = 2) -> DataFrame:
    """Pairs weighted by the number of articles, with the first of them and a description."""
    pairs = entity_pairs(by_entity(facts)).groupBy("entity_a", "entity_b")
    counted = pairs.agg(F.count(F.lit(1)).alias("articles"), F.round(F.avg((F.col("confidence_a") + F.col("confidence_b")) / 2), 6).alias("confidence"), F.min("article_id").alias("first_article"))
    return counted.where(F.col("articles") >= min_articles).withColumn("description", F.concat(F.lit("Appears together in "), F.col("articles").cast("string"), F.lit(" article(s)")))


@query("a16_weighted_pairs", over("facts", "SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS articles, round(avg((a.confidence + b.confidence) / 2), 6) AS confidence, min(a.article_id) AS first_article, 'Appears together in ' || count(*) || ' article(s)' AS description FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2"))
def a16(m: Model) -> DataFrame:
    return weighted_pairs(m.facts)


def hybrid_pairs(facts: DataFrame, min_confidence: float = 0.6, min_articles: int = 2, important: int = 5, focused: int = 20, either: bool = False, articles: DataFrame | None = None) -> DataFrame:
    """All occurrences of the pairs that qualify: in several articles, or once between important entities, or once in a focused article.

    Both ends of a single pair must be important, or with ``either`` one of them.  ``articles`` (article_id), where
    given, are those that pairs come from; importance and focus are those of all facts.
    """
    confident = by_entity(facts.where(F.col("confidence") >= min_confidence))
    density = confident.groupBy("article_id").agg(F.count(F.lit(1)).alias("entities"))
    weight = confident.groupBy("entity").agg(F.count(F.lit(1)).alias("w"))
    heavy = weight.where(F.col("w") >= important).select("entity")
    key = ["entity_a", "entity_b"]
    end = lambda c: heavy.select(F.col("entity").alias(f"entity_{c}"), F.lit(True).alias(f"heavy_{c}"))
    inside = confident if articles is None else confident.join(articles, "article_id", "left_semi")
    pairs = entity_pairs(inside).join(density, "article_id")
    support = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("articles"), F.min("entities").alias("entities"))
    alone = support.join(end("a"), "entity_a", "left").join(end("b"), "entity_b", "left")
    known = [F.coalesce(f"heavy_{c}", F.lit(False)) for c in "ab"]
    weighty = known[0] | known[1] if either else known[0] & known[1]
    qualified = alone.where((F.col("articles") >= min_articles) | (F.col("entities") <= focused) & (F.col("articles") == 1) | weighty & (F.col("articles") == 1))
    return pairs.drop("entities").join(qualified.select(*key), key).select("article_id", *key, F.round((F.col("confidence_a") + F.col("confidence_b")) / 2, 6).alias("confidence"))


@query("g15_hybrid_pairs", over("facts", "SELECT article_id, entity_a, entity_b, round(c, 6) AS confidence FROM pairs JOIN q USING (entity_a, entity_b)", "k AS (SELECT * FROM facts WHERE confidence >= 0.6)", "pairs AS (SELECT a.article_id, a.entity AS entity_a, b.entity AS entity_b, (a.confidence + b.confidence) / 2 AS c FROM k a JOIN k b ON a.article_id = b.article_id AND a.entity < b.entity)", "s AS (SELECT entity_a, entity_b, count(DISTINCT article_id) AS n, min(article_id) AS o FROM pairs GROUP BY 1, 2)", "w AS (SELECT entity FROM k GROUP BY entity HAVING count(DISTINCT article_id) >= 16)", "d AS (SELECT article_id FROM k GROUP BY article_id HAVING count(DISTINCT entity) <= 2)", "q AS (SELECT entity_a, entity_b FROM s WHERE n >= 2 UNION SELECT entity_a, entity_b FROM s WHERE n = 1 AND entity_a IN (SELECT entity FROM w) AND entity_b IN (SELECT entity FROM w) UNION SELECT entity_a, entity_b FROM s WHERE n = 1 AND o IN (SELECT article_id FROM d))"))
def g15(m: Model) -> DataFrame:
    return hybrid_pairs(m.facts, important=16, focused=2)


@query("g15b_hybrid_defaults", over("facts", "SELECT article_id, entity_a, entity_b, round(c, 6) AS confidence FROM pairs JOIN q USING (entity_a, entity_b)", "k AS (SELECT * FROM facts WHERE confidence >= 0.6)", "pairs AS (SELECT a.article_id, a.entity AS entity_a, b.entity AS entity_b, (a.confidence + b.confidence) / 2 AS c FROM k a JOIN k b ON a.article_id = b.article_id AND a.entity < b.entity)", "s AS (SELECT entity_a, entity_b, count(DISTINCT article_id) AS n, min(article_id) AS o FROM pairs GROUP BY 1, 2)", "w AS (SELECT entity FROM k GROUP BY entity HAVING count(DISTINCT article_id) >= 5)", "d AS (SELECT article_id FROM k GROUP BY article_id HAVING count(DISTINCT entity) <= 20)", "q AS (SELECT entity_a, entity_b FROM s WHERE n >= 2 UNION SELECT entity_a, entity_b FROM s WHERE n = 1 AND entity_a IN (SELECT entity FROM w) AND entity_b IN (SELECT entity FROM w) UNION SELECT entity_a, entity_b FROM s WHERE n = 1 AND o IN (SELECT article_id FROM d))"))
def g15b(m: Model) -> DataFrame:
    return hybrid_pairs(m.facts)


def completed_since(articles: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(article_id) of the articles that are completed and were published in the last ``days`` days."""
    return articles.where((F.col("processing_status") == "completed") & (F.col("published_date") >= as_of - F.expr(f"INTERVAL {days} DAYS"))).select(F.col("id").alias("article_id"))


def hybrid_strategy(facts: DataFrame, articles: DataFrame, as_of: Column, days: int = 180, min_articles: int = 2, important: int = 3, focused: int = 20) -> DataFrame:
    """The surveyed hybrid strategy: pairs of recent completed articles, single ones kept where either end is important or their article focused."""
    return hybrid_pairs(facts, 0.6, min_articles, important, focused, True, completed_since(articles, as_of, days))


def weighted_strategy(facts: DataFrame, articles: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """The surveyed frequency-weighted strategy: confident pairs of recent completed articles."""
    inside = facts.where("confidence >= 0.6D").join(completed_since(articles, as_of, days), "article_id", "left_semi")
    return weighted_pairs(inside)


def two_types(m: Model) -> DataFrame:
    """The model's facts, a third of whose entities are known in their articles under a second type, less surely."""
    other = m.facts.where("CAST(substr(entity, 2) AS BIGINT) % 3 = 0").withColumns({"entity_type": F.lit("OTHER"), "confidence": F.col("confidence") / 2})
    return m.facts.unionByName(other).select("article_id", "entity", "entity_type", "confidence")


_TWO = "two AS (SELECT article_id, entity, entity_type, confidence FROM facts UNION ALL SELECT article_id, entity, 'OTHER', confidence / 2 FROM facts WHERE CAST(substr(entity, 2) AS BIGINT) % 3 = 0), one AS (SELECT article_id, entity, max(confidence) AS confidence FROM two GROUP BY 1, 2)"
_TWO_PAIRS = "pairs AS (SELECT a.article_id, a.entity AS entity_a, b.entity AS entity_b, (a.confidence + b.confidence) / 2 AS c FROM one a JOIN one b ON a.article_id = b.article_id AND a.entity < b.entity)"


@query("a15c_support_two_types", over("facts", "SELECT a.entity AS entity_a, b.entity AS entity_b, count(DISTINCT a.article_id) AS articles FROM two a JOIN two b ON a.article_id = b.article_id AND a.entity < b.entity WHERE a.confidence >= 0.6 AND b.confidence >= 0.6 GROUP BY 1, 2", _TWO))
def a15c(m: Model) -> DataFrame:
    return pair_support(two_types(m))


@query("a16b_weighted_two_types", over("facts", "SELECT entity_a, entity_b, count(DISTINCT article_id) AS articles, round(avg(c), 6) AS confidence, min(article_id) AS first_article, 'Appears together in ' || count(DISTINCT article_id) || ' article(s)' AS description FROM pairs GROUP BY 1, 2 HAVING count(DISTINCT article_id) >= 2", _TWO, _TWO_PAIRS))
def a16b(m: Model) -> DataFrame:
    return weighted_pairs(two_types(m))


_RECENT = f"recent AS (SELECT id AS article_id FROM articles WHERE processing_status = 'completed' AND published_date >= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAYS)"


@query("a16c_weighted_strategy", over("facts articles", "SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS articles, round(avg((a.confidence + b.confidence) / 2), 6) AS confidence, min(article_id) AS first_article, 'Appears together in ' || count(*) || ' article(s)' AS description FROM one a JOIN one b USING (article_id) WHERE a.entity < b.entity AND a.confidence >= 0.6 AND b.confidence >= 0.6 AND article_id IN (FROM recent) GROUP BY 1, 2 HAVING count(*) >= 2", _TWO, _RECENT))
def a16c(m: Model) -> DataFrame:
    return weighted_strategy(two_types(m), m.articles, F.lit(AS_OF).cast("timestamp_ntz"), 900)


@query("a18c_frequency_two_types", over("facts", "SELECT entity, count(DISTINCT article_id) AS articles, (SELECT count(DISTINCT article_id) FROM two) AS n_articles FROM two GROUP BY entity", _TWO))
def a18c(m: Model) -> DataFrame:
    return document_frequency(two_types(m))


@query("m01b_pmi_two_types", over("facts", """SELECT entity_a, entity_b, n_ab, round(ln(pxy / (px * py + 1e-6) + 1e-6), 6) AS pmi FROM (SELECT entity_a, entity_b, n_ab, (n_ab + 1e-6) / (n + 1e-6) AS pxy, (x.k + 1e-6) / (n + 1e-6) AS px, (y.k + 1e-6) / (n + 1e-6) AS py
FROM (SELECT entity_a, entity_b, count(DISTINCT article_id) AS n_ab FROM pairs GROUP BY 1, 2 HAVING count(DISTINCT article_id) >= 2) JOIN d x ON x.entity = entity_a JOIN d y ON y.entity = entity_b CROSS JOIN (SELECT CAST(count(DISTINCT article_id) AS DOUBLE) AS n FROM two))""", _TWO, _TWO_PAIRS, "d AS (SELECT entity, count(DISTINCT article_id) AS k FROM two GROUP BY 1)"))
def m01b(m: Model) -> DataFrame:
    return corpus_pmi(two_types(m)).select("entity_a", "entity_b", "n_ab", F.round("pmi", 6).alias("pmi"))


@query("g15c_hybrid_strategy", over("facts articles", """SELECT article_id, entity_a, entity_b, round(c, 6) AS confidence FROM p JOIN q USING (entity_a, entity_b)""", _TWO, _RECENT,
"k AS (SELECT * FROM two WHERE confidence >= 0.6)", "w AS (SELECT entity FROM k GROUP BY entity HAVING count(DISTINCT article_id) >= 18)", "d AS (SELECT article_id FROM k GROUP BY article_id HAVING count(DISTINCT entity) <= 2)",
"p AS (SELECT a.article_id, a.entity AS entity_a, b.entity AS entity_b, (a.confidence + b.confidence) / 2 AS c FROM one a JOIN one b ON a.article_id = b.article_id AND a.entity < b.entity WHERE a.confidence >= 0.6 AND b.confidence >= 0.6 AND a.article_id IN (FROM recent))",
"s AS (SELECT entity_a, entity_b, count(DISTINCT article_id) AS n, min(article_id) AS o FROM p GROUP BY 1, 2)",
"q AS (SELECT entity_a, entity_b FROM s WHERE n >= 2 UNION SELECT entity_a, entity_b FROM s WHERE n = 1 AND (entity_a IN (FROM w) OR entity_b IN (FROM w)) UNION SELECT entity_a, entity_b FROM s WHERE n = 1 AND o IN (FROM d))"))
def g15c(m: Model) -> DataFrame:
    return hybrid_strategy(two_types(m), m.articles, F.lit(AS_OF).cast("timestamp_ntz"), 900, important=18, focused=2)


def relation_type(distance: Column) -> Column:
    return F.when(distance == 0, "same-sentence").when(distance == 1, "adjacent-sentence").otherwise("near-proximity")


@query("t16_relation_types", over("mentions", "SELECT CASE min_distance WHEN 0 THEN 'same-sentence' WHEN 1 THEN 'adjacent-sentence' ELSE 'near-proximity' END AS relationship_type, count(*) AS relations, round(avg(total_weight), 1) AS avg_weight, printf('%.1f', round(avg(avg_distance), 1)) AS description FROM matrix GROUP BY 1", _MATRIX))
def t16(m: Model) -> DataFrame:
    typed = cooccurrence_matrix(m.mentions).groupBy(relation_type(F.col("min_distance")).alias("relationship_type"))
    return typed.agg(F.count(F.lit(1)).alias("relations"), F.round(F.avg("total_weight"), 1).alias("avg_weight"), F.format_string("%.1f", F.round(F.avg("avg_distance"), 1)).alias("description"))


@query("a30_relation_counts", over("mentions", "SELECT CASE min_distance WHEN 0 THEN 'same-sentence' WHEN 1 THEN 'adjacent-sentence' ELSE 'near-proximity' END AS relationship_type, count(*) AS relations, round(avg(total_weight), 1) AS avg_weight, round(avg(min_distance), 3) AS avg_min_distance FROM matrix GROUP BY 1", _MATRIX))
def a30(m: Model) -> DataFrame:
    typed = cooccurrence_matrix(m.mentions).groupBy(relation_type(F.col("min_distance")).alias("relationship_type"))
    return typed.agg(F.count(F.lit(1)).alias("relations"), F.round(F.avg("total_weight"), 1).alias("avg_weight"), F.round(F.avg("min_distance"), 3).alias("avg_min_distance"))


@query("a31_relation_coverage", over("mentions", "SELECT count(DISTINCT article_id) AS articles, min(total_weight) AS min_weight, max(total_weight) AS max_weight, round(avg(total_weight), 6) AS avg_weight FROM matrix", _MATRIX))
def a31(m: Model) -> DataFrame:
    return cooccurrence_matrix(m.mentions).agg(F.count_distinct("article_id").alias("articles"), F.min("total_weight").alias("min_weight"), F.max("total_weight").alias("max_weight"), F.round(F.avg("total_weight"), 6).alias("avg_weight"))


@query("a32_weekly_relations", over("articles facts", "SELECT date_trunc('week', published_date)::TIMESTAMP AS week, count(*) AS relations, count(DISTINCT a.id) AS articles FROM p JOIN articles a ON a.id = p.article_id GROUP BY 1 ORDER BY 1 DESC LIMIT 8", "p AS (SELECT x.article_id FROM facts x JOIN facts y ON x.article_id = y.article_id AND x.entity < y.entity)"))
def a32(m: Model) -> DataFrame:
    per_article = entity_pairs(m.facts).groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    weekly = m.articles.join(per_article, "id").groupBy(F.date_trunc("week", "published_date").cast("timestamp_ntz").alias("week"))
    return weekly.agg(F.sum("n").alias("relations"), F.count_distinct("id").alias("articles")).orderBy(F.desc("week")).limit(8)


@query("a34_nested_aggregates", over("facts", "SELECT min(n) AS min_articles, max(n) AS max_articles, round(avg(n), 6) AS avg_articles FROM (SELECT count(*) AS n FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity GROUP BY a.entity, b.entity)"))
def a34(m: Model) -> DataFrame:
    per_pair = entity_pairs(dealt(m.facts.select("article_id", "entity", "confidence"))).groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("n"))
    return per_pair.agg(F.min("n").alias("min_articles"), F.max("n").alias("max_articles"), F.round(F.avg("n"), 6).alias("avg_articles"))


@query("a35_top_pairs", over("facts", "SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS frequency FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity GROUP BY 1, 2 ORDER BY frequency DESC, 1, 2 LIMIT 20"))
def a35(m: Model) -> DataFrame:
    return entity_pairs(dealt(m.facts.select("article_id", "entity", "confidence"))).groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), "entity_a", "entity_b").limit(20)


@query("a36_temporal_pairs", over("articles facts", "SELECT a.entity AS entity_a, b.entity AS entity_b, min(published_date) AS first_seen, max(published_date) AS last_seen, count(*) AS frequency FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity JOIN articles r ON r.id = a.article_id GROUP BY 1, 2 HAVING count(*) >= 2"))
def a36(m: Model) -> DataFrame:
    dated = entity_pairs(m.facts).join(m.articles.select(F.col("id").alias("article_id"), "published_date"), "article_id")
    return dated.groupBy("entity_a", "entity_b").agg(F.min("published_date").alias("first_seen"), F.max("published_date").alias("last_seen"), F.count(F.lit(1)).alias("frequency")).where("frequency >= 2")


@query("a06_edge_groups", over("facts", "SELECT a.entity AS entity_a, b.entity AS entity_b, count(DISTINCT a.article_id) AS articles, count(*) AS relations FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity WHERE a.entity = 'E0000007' OR b.entity = 'E0000007' GROUP BY 1, 2"))
def a06(m: Model) -> DataFrame:
    # The focal entity's articles are found first: pairs are made only inside them.
    there = m.facts.where("entity = 'E0000007'").select("article_id")
    pairs = entity_pairs(m.facts.join(there, "article_id", "left_semi")).where("entity_a = 'E0000007' OR entity_b = 'E0000007'")
    return pairs.groupBy("entity_a", "entity_b").agg(F.count_distinct("article_id").alias("articles"), F.count(F.lit(1)).alias("relations"))


@query("a07_dominant_type", over("facts", "SELECT entity, entity_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM facts WHERE entity = 'E0000007' GROUP BY 1, 2 ORDER BY n DESC, entity_type LIMIT 1"))
def a07(m: Model) -> DataFrame:
    return m.facts.where("entity = 'E0000007'").groupBy("entity", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")).orderBy(F.desc("n"), "entity_type").limit(1)
