"""Scoring formulas as Column expressions, and the queries that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.proxy import Model, over
from ..plans.registry import query

#: Dollars for a million tokens (input, output) of each hosted model, and the share of articles arbitrated.
RATES = {"claude": (3.0, 15.0), "gemini": (0.075, 0.3), "gpt": (0.15, 0.6)}
ARBITRATION_SHARE = 0.30
#: Budget caps in dollars and the shares of them at which a warning is due.
MONTHLY_CAP, DAILY_CAP = 50.0, 10.0
MONTHLY_WARN, DAILY_WARN = 0.9, 0.8
#: Fixed values by size class: the most entities, score threshold, degree cap, percentile.
SIZES = (("small", 10, 0.3, 5, 70), ("medium", 25, 0.5, 8, 60), ("large", None, 0.6, 10, 50))


def distance_weight(distance: Column) -> Column:
    return F.when(distance == 0, F.lit(3.0)).when(distance == 1, F.lit(2.0)).otherwise(F.lit(1.0))


def pmi_columns(n_ab: Column, n_a: Column, n_b: Column, n: Column, s: float) -> dict[str, Column]:
    """Smoothed pointwise mutual information and its normalised form."""
    share = lambda c: (c.cast("double") + s) / (n.cast("double") + s)
    pmi = F.ln(share(n_ab) / (share(n_a) * share(n_b) + s) + s)
    return {"pmi": pmi, "npmi": pmi / (-F.ln(share(n_ab) + s) + s)}


def combined_confidence(a: Column, b: Column, mode: str) -> Column:
    if mode == "multiply":
        return a * b
    if mode == "harmonic":
        return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(2 * a * b / F.nullif(a + b, F.lit(0.0)))
    if mode == "min":
        return F.least(a, b)
    if mode == "average":
        return (a + b) / 2
    raise ValueError(f"no mode {mode}")


def size_class(n: Column, field: int = 0) -> Column:
    """A field of the size class that ``n`` entities fall in: 0 name, 2 threshold, 3 degree cap, 4 percentile."""
    small, medium, large = SIZES
    return F.when(n <= small[1], F.lit(small[field])).when(n <= medium[1], F.lit(medium[field])).otherwise(F.lit(large[field]))


def budget_state(month: Column, day: Column) -> Column:
    """exceeded, warning or ok."""
    return (
        F.when((month >= MONTHLY_CAP) | (day >= DAILY_CAP), "exceeded")
        .when((month >= MONTHLY_CAP * MONTHLY_WARN) | (day >= DAILY_CAP * DAILY_WARN), "warning")
        .otherwise("ok")
    )


def exit_code(share: Column) -> Column:
    """0, 1 from 80 % and 2 from 90 % of a cap."""
    return F.when(share >= 0.9, 2).when(share >= 0.8, 1).otherwise(0)


def token_cost(model: str, tokens_in: Column, tokens_out: Column) -> Column:
    rate_in, rate_out = RATES[model]
    return (tokens_in * rate_in + tokens_out * rate_out) / 1e6


def edge_strength(npmi: Column, proximity: Column, confidence: Column) -> tuple[Column, Column]:
    """An edge's score, NPMI or else bounded proximity, and its strength under confidence."""
    score = F.coalesce(npmi, F.least(F.lit(1.0), proximity / 10))
    return score, F.least(score * confidence, F.lit(1.0))


def edge_weight(strength: Column, npmi: Column, proximity: Column) -> Column:
    """The first of strength, NPMI (never below 0) and proximity / 10 that is neither null nor zero, else 1."""
    some = lambda c: F.when(c != 0, c)
    return F.coalesce(some(strength), some(F.greatest(npmi, F.lit(0.0))), some(proximity / 10), F.lit(1.0))


def merged_confidence(a: Column, b: Column) -> Column:
    """Of a fact that both extractors found (mean + 0.1) or one alone (its own - 0.1), within [0, 1]."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least((a + b) / 2 + 0.1, F.lit(1.0))).otherwise(F.greatest(F.coalesce(a, b) - 0.1, F.lit(0.0)))


@query("m02_distance_weight", over("mentions", "SELECT sentence_index, CASE sentence_index WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, count(*) AS n FROM mentions GROUP BY 1, 2"))
def m02(m: Model) -> DataFrame:
    return m.mentions.groupBy("sentence_index", distance_weight(F.col("sentence_index")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("m03_confidence_modes", "SELECT l_orderkey, l_linenumber, l_partkey, round(a * b, 6) AS multiply, round(CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE 2 * a * b / (a + b) END, 6) AS harmonic, least(a, b) AS minimum, round((a + b) / 2, 6) AS average FROM (SELECT *, l_quantity / CAST(50 AS DOUBLE) AS a, l_discount * 10 AS b FROM lineitem)")
def m03(m: Model) -> DataFrame:
    a, b = F.expr("l_quantity / 50D"), F.expr("l_discount * 10")
    mode = lambda name: combined_confidence(a, b, name)
    return m.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(mode("multiply"), 6).alias("multiply"), F.round(mode("harmonic"), 6).alias("harmonic"), mode("min").alias("minimum"), F.round(mode("average"), 6).alias("average"))


@query("m04_knowledge_boost", over("facts", "SELECT article_id, entity, round(CASE WHEN wikidata_id IS NOT NULL THEN least(1.0, confidence + 0.1) ELSE confidence END, 6) AS boosted FROM facts"))
def m04(m: Model) -> DataFrame:
    boosted = F.when(F.col("wikidata_id").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))
    return m.facts.select("article_id", "entity", F.round(boosted, 6).alias("boosted"))


@query("m05_merged_confidence", "WITH a AS (SELECT l_orderkey, l_partkey, max(l_quantity) / CAST(50 AS DOUBLE) AS c FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_partkey, max(l_quantity) / CAST(50 AS DOUBLE) AS d FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2) SELECT l_orderkey, l_partkey, round(CASE WHEN c IS NOT NULL AND d IS NOT NULL THEN least((c + d) / 2 + 0.1, 1.0) ELSE greatest(coalesce(c, d) - 0.1, 0.0) END, 6) AS confidence FROM a FULL JOIN b USING (l_orderkey, l_partkey)")
def m05(m: Model) -> DataFrame:
    side = lambda flag, name: m.table("lineitem").where(F.col("l_returnflag") != flag).groupBy("l_orderkey", "l_partkey").agg((F.max("l_quantity") / 50.0).alias(name))
    return side("N", "c").join(side("A", "d"), ["l_orderkey", "l_partkey"], "full").select("l_orderkey", "l_partkey", F.round(merged_confidence(F.col("c"), F.col("d")), 6).alias("confidence"))


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


@query("m06_cosine_similarity", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m06(m: Model) -> DataFrame:
    e = m.table("embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(cosine("x", "y"), 6).alias("similarity"))


def conflict_flags(similarity: Column, overlap: Column, type_mismatch: Column, gap: Column) -> dict[str, Column]:
    """Which rules find two extractions in conflict, and whether to arbitrate."""
    flags = {"low_similarity": similarity < 0.75, "low_overlap": overlap < 0.5, "type_mismatch": type_mismatch, "confidence_gap": gap > 0.3}
    anyone = flags["low_similarity"] | flags["low_overlap"] | flags["type_mismatch"] | flags["confidence_gap"]
    return flags | {"has_conflict": anyone, "arbitrate": anyone & (similarity < 0.6)}


@query("m07_conflict_rules", "SELECT *, low_similarity OR low_overlap OR type_mismatch OR confidence_gap AS has_conflict, (low_similarity OR low_overlap OR type_mismatch OR confidence_gap) AND similarity < 0.6 AS arbitrate FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / CAST(50 AS DOUBLE) AS similarity, l_quantity / CAST(50 AS DOUBLE) < 0.75 AS low_similarity, l_tax * 10 < 0.5 AS low_overlap, l_returnflag = 'R' AS type_mismatch, l_discount * 5 > 0.3 AS confidence_gap FROM lineitem)")
def m07(m: Model) -> DataFrame:
    s = F.expr("l_quantity / 50D")
    flags = conflict_flags(s, F.col("l_tax") * 10, F.col("l_returnflag") == "R", F.col("l_discount") * 5)
    return m.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.alias("similarity"), *[c.alias(n) for n, c in flags.items()])


#: What stands in for a summary, and what a report says, where extractions failed.
NO_SUMMARY, ONE_FAILED, BOTH_FAILED = "[Extraction failed]", "%s extraction failed", "Both models failed"


def consensus(first: Column, second: Column, first_ok: Column, second_ok: Column, similarity: Column, names: tuple[str, str] = ("First", "Second")) -> dict[str, Column]:
    """The text that two extractors' summaries give, whose facts to take (both, first, second, none) and what the report says of failures.

    Like summaries: the first's.  Unlike ones: both, the second marked.  If one failed the other's alone; if both
    did a stand-in.  A null success counts as a failure, a null similarity as unlike, null summaries as empty.
    """
    a, b = (F.coalesce(c, F.lit("")) for c in (first, second))
    one, two = (F.coalesce(c, F.lit(False)) for c in (first_ok, second_ok))
    alike = F.coalesce(similarity >= 0.75, F.lit(False))
    both = F.when(alike, a).otherwise(F.concat(a, F.lit(" [Alternative perspective: "), b, F.lit("]")))
    return {
        "summary": F.when(one & two, both).when(one, a).when(two, b).otherwise(F.lit(NO_SUMMARY)),
        "facts_of": F.when(one & two, "both").when(one, "first").when(two, "second").otherwise("none"),
        "failure": F.when(one & two, F.lit(None).cast("string")).when(one, ONE_FAILED % names[1]).when(two, ONE_FAILED % names[0]).otherwise(BOTH_FAILED),
    }


@query("m07b_consensus", """WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS a, coalesce(string_split(text, chr(10))[2], '') AS b, doc_id % 5 <> 1 AS p, doc_id % 7 <> 2 AS q, (doc_id % 100) / CAST(100 AS DOUBLE) AS s FROM documents)
SELECT doc_id, CASE WHEN p AND q THEN CASE WHEN s >= 0.75 THEN a ELSE a || ' [Alternative perspective: ' || b || ']' END WHEN p THEN a WHEN q THEN b ELSE '[Extraction failed]' END AS summary,
 CASE WHEN p AND q THEN 'both' WHEN p THEN 'first' WHEN q THEN 'second' ELSE 'none' END AS facts_of,
 CASE WHEN p AND q THEN NULL WHEN p THEN 'Second extraction failed' WHEN q THEN 'First extraction failed' ELSE 'Both models failed' END AS failure FROM d""")
def m07b(m: Model) -> DataFrame:
    lines = F.split("text", "\n")
    told = consensus(F.get(lines, F.lit(0)), F.get(lines, F.lit(1)), F.col("doc_id") % 5 != 1, F.col("doc_id") % 7 != 2, (F.col("doc_id") % 100) / 100.0)
    return m.table("documents").select("doc_id", *[c.alias(n) for n, c in told.items()])


@query("m08_article_cost", "SELECT o_orderkey, round((o_totalprice * 3.0 + o_custkey * 15.0) / 1e6 + (o_totalprice * 0.075 + o_custkey * 0.3) / 1e6 + 0.30 * (o_totalprice * 0.15 + o_custkey * 0.6) / 1e6, 4) AS cost FROM orders")
def m08(m: Model) -> DataFrame:
    tokens = (F.col("o_totalprice"), F.col("o_custkey"))
    total = token_cost("claude", *tokens) + token_cost("gemini", *tokens) + ARBITRATION_SHARE * token_cost("gpt", *tokens)
    return m.table("orders").select("o_orderkey", F.round(total, 4).alias("cost"))


@query("m09_budget_state", "SELECT d, CASE WHEN mtd >= 50 OR c >= 10 THEN 'exceeded' WHEN mtd >= 45 OR c >= 8 THEN 'warning' ELSE 'ok' END AS state, CASE WHEN mtd / 50 >= 0.9 THEN 2 WHEN mtd / 50 >= 0.8 THEN 1 ELSE 0 END AS code FROM (SELECT d, c, sum(c) OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS mtd FROM (SELECT CAST(o_orderdate AS DATE) AS d, sum(round(o_totalprice)) / 1e6 AS c FROM orders GROUP BY 1))")
def m09(m: Model) -> DataFrame:
    from pyspark.sql import Window

    daily = m.table("orders").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.sum(F.round("o_totalprice")) / 1e6).alias("c"))
    mtd = F.sum("c").over(Window.partitionBy(F.date_trunc("month", "d")).orderBy("d"))
    return daily.withColumn("mtd", mtd).select("d", budget_state(F.col("mtd"), F.col("c")).alias("state"), exit_code(F.col("mtd") / MONTHLY_CAP).alias("code"))


@query("m10_edge_strength", "SELECT l_orderkey, l_linenumber, l_partkey, round(s, 6) AS score, round(least(s * l_tax * 10, 1.0), 6) AS strength FROM (SELECT *, coalesce(CASE WHEN l_returnflag = 'A' THEN l_discount * 10 END, least(1.0, l_quantity / 10)) AS s FROM lineitem)")
def m10(m: Model) -> DataFrame:
    score, strength = edge_strength(F.when(F.col("l_returnflag") == "A", F.col("l_discount") * 10), F.col("l_quantity"), F.col("l_tax") * 10)
    return m.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"), F.round(strength, 6).alias("strength"))


@query("m11_size_class", over("facts", "SELECT article_id, CASE WHEN n <= 10 THEN 'small' WHEN n <= 25 THEN 'medium' ELSE 'large' END AS size_class, CASE WHEN n <= 10 THEN 5 WHEN n <= 25 THEN 8 ELSE 10 END AS degree_cap, CAST(CASE WHEN n <= 10 THEN 0.3 WHEN n <= 25 THEN 0.5 ELSE 0.6 END AS DOUBLE) AS threshold FROM (SELECT article_id, 4 * count(*) AS n FROM facts GROUP BY 1)"))
def m11(m: Model) -> DataFrame:
    n = F.col("n")
    counted = m.facts.groupBy("article_id").agg((4 * F.count(F.lit(1))).alias("n"))
    return counted.select("article_id", size_class(n).alias("size_class"), size_class(n, 3).alias("degree_cap"), size_class(n, 2).alias("threshold"))


@query("m12_edge_estimate", over("facts", "SELECT article_id, n * (n - 1) // 2 AS possible, least(n * (n - 1) // 2, n * 5 // 2) AS estimate, round(100.0 * (1 - least(n * (n - 1) // 2, n * 5 // 2) / CAST(nullif(n * (n - 1) // 2, 0) AS DOUBLE)), 2) AS reduction FROM (SELECT article_id, count(*) AS n FROM facts GROUP BY 1)"))
def m12(m: Model) -> DataFrame:
    counted = m.facts.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    named = counted.selectExpr("article_id", "n * (n - 1) div 2 AS possible", "least(n * (n - 1) div 2, n * 5 div 2) AS estimate")
    return named.withColumn("reduction", F.round(100.0 * (1 - F.try_divide(F.col("estimate").cast("double"), F.col("possible"))), 2))


@query("m13_temporal_flag", over("facts", "SELECT article_id, entity, CASE WHEN confidence < 0.4 THEN 'low_confidence' END AS flag FROM facts"))
def m13(m: Model) -> DataFrame:
    return m.facts.select("article_id", "entity", F.when(F.col("confidence") < 0.4, "low_confidence").alias("flag"))


@query("m14_edge_weight", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount <> 0 THEN l_discount WHEN l_tax <> 0 THEN l_tax WHEN l_quantity > 0 THEN l_quantity / 10 ELSE 1 END, 6) AS weight FROM lineitem")
def m14(m: Model) -> DataFrame:
    return m.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(edge_weight(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")), 6).alias("weight"))
