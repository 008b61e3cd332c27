"""Queries beyond SQL: invariants, and plain-Python forms on small graphs."""

import numpy as np
from pyspark.sql import functions as F

from lorekiln.functions import scores, text
from lorekiln.operators import graph, prune, reconcile
from lorekiln.plans.catalog import QUERIES


def test_degree_cap_holds_at_every_node(spark, sf):
    kept = QUERIES["w03_degree_cap"](spark, sf)
    ends = kept.select("article_id", F.explode(F.array("source", "target")).alias("n")).groupBy("article_id", "n").count()
    assert ends.agg(F.max("count")).first()[0] <= 2


def test_fallback_keeps_three(spark):
    rows = [(1, a, b, s) for a, b, s in (("A", "B", 0.1), ("A", "C", 0.05), ("B", "C", 0.15), ("C", "D", 0.08))]
    kept = prune.with_fallback(spark.createDataFrame(rows, "article_id long, source string, target string, score double"), 0.6)
    assert sorted(r["score"] for r in kept.collect()) == [0.08, 0.1, 0.15]


def test_percentile_is_linear(spark):
    rows = [(1, f"N{i}", f"N{i + 1}", 0.3 + i * 0.1) for i in range(8)]
    kept = prune.percentile_edges(spark.createDataFrame(rows, "article_id long, source string, target string, score double"), 0.7)
    assert sorted(round(r["score"], 1) for r in kept.collect()) == [0.8, 0.9, 1.0]


def test_small_graph_measures():
    path = np.zeros((4, 4))
    for i in range(3):
        path[i, i + 1] = path[i + 1, i] = 1.0
    assert abs(graph.pagerank(path).sum() - 1) < 1e-6
    assert np.allclose(graph.betweenness(path), [0, 2 / 3, 2 / 3, 0])
    two = np.kron(np.eye(2), np.ones((3, 3)) - np.eye(3))
    two[2, 3] = two[3, 2] = 0.1
    assert graph.louvain(two) == [0, 0, 0, 1, 1, 1]
    assert graph.spring_layout(two).shape == (6, 2) and np.array_equal(graph.spring_layout(two), graph.spring_layout(two))


def test_pmi_vectors(spark):
    n = lambda v: F.lit(float(v))
    row = spark.range(1).select(*[c.alias(k) for k, c in scores.pmi_columns(n(25), n(50), n(50), n(100), 1e-6).items()]).first()
    assert abs(row["pmi"]) < 1e-5 and abs(row["npmi"]) < 1e-5


def test_cost_vector(spark):
    t = (F.lit(1000), F.lit(500))
    total = scores.token_cost("claude", *t) + scores.token_cost("gemini", *t) + scores.ARBITRATION_SHARE * scores.token_cost("gpt", *t)
    assert abs(spark.range(1).select(total.alias("x")).first()["x"] - 0.01086) < 1e-9


def test_entity_names(spark):
    rows = [("Vermont Governor Phil Scott", "PERSON"), ("Rutland City Mayor Mike Doenges", "PERSON"), ("The Bridge", "ORGANIZATION"), ("The Hague", "LOCATION")]
    df = spark.createDataFrame(rows, "n string, t string").select(text.normalize_entity(F.col("n"), F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["Vermont Phil Scott", "Rutland Mike Doenges", "Bridge", "The Hague"]


def test_occurrences(spark):
    df = spark.createDataFrame([("Ann met ann. ANN!", "ann"), ("none", "ann"), ("a.b a.b", "a.b")], "t string, n string")
    assert [list(r["x"]) for r in df.select(text.occurrences(F.col("t"), F.col("n")).alias("x")).collect()] == [[0, 8, 13], [], [0, 4]]


def test_greedy_match(spark):
    a = spark.createDataFrame([(1, "Phil Scott"), (1, "State House")], "article_id long, name string")
    b = spark.createDataFrame([(1, "phil scott"), (1, "Lake")], "article_id long, name string")
    got = {(r["a"], r["b"]) for r in reconcile.matched(a, b).collect()}
    assert got == {("Phil Scott", "phil scott"), ("State House", None), (None, "Lake")}
    placed = lambda names: spark.createDataFrame([(1, k, n) for k, n in enumerate(names)], "article_id long, position int, name string")
    # The first fact takes the partner, whatever the alphabet says.
    got = {(r["a"], r["b"]) for r in reconcile.matched(placed(["Zed Corp", "Zed Cor"]), placed(["Zed Corp."])).collect()}
    assert got == {("Zed Corp", "Zed Corp."), ("Zed Cor", None)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "article_id long, source string, target string, score double")
    assert prune.degree_cap(none, 3).count() == 0 and graph.graph_metrics(none).count() == 0 and prune.top_k_edges(none).count() == 0
