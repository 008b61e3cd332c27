"""Degree caps in rounds, percentiles by narrowing and indexed search, held against the plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekiln.operators import prune, search
from lorekiln.plans.proxy import Model

EDGES = "article_id long, source string, target string, score double"


def graph(rng, article, nodes, n, scores=50):
    return [(article, f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.randrange(scores) / scores) for _ in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cap", [1, 4])
def test_rounds_equal_the_stream(spark, cap):
    """Random graphs with ties, repeated edges, edges from a node to itself, a star and a long chain of dependent edges."""
    rng = random.Random(cap)
    edges = graph(rng, 1, 40, 400) + graph(rng, 2, 8, 120, 4) + [(3, "hub", f"x{k}", k / 100) for k in range(100)]
    edges += [(4, f"c{k:03}", f"c{k + 1:03}", 1 - k / 200) for k in range(120)] + [(5, "a", "a", 0.9), (5, "a", "b", 0.8), (5, "a", "a", 0.7), (5, "b", "b", 0.1)]
    df = spark.createDataFrame(edges, EDGES)
    wanted = rows(prune.degree_cap(df, cap))
    for rounds in (3,):
        assert rows(prune.degree_cap_in_rounds(df, cap, rounds)) == wanted
    assert rows(prune.degree_cap_in_rounds(df.where("false"), cap)) == []


def test_rounds_follow_strength(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(*e, rng.randrange(5) / 5) for e in graph(rng, 1, 20, 200)], EDGES + ", confidence double")
    assert rows(prune.degree_cap_in_rounds(df, 2)) == rows(prune.degree_cap(df, 2))


def test_only_large_articles_go_in_rounds(spark, monkeypatch):
    rng = random.Random(12)
    edges = [e for a in range(6) for e in graph(rng, a, 9, 30)] + graph(rng, 9, 20, 200)
    df, seen = spark.createDataFrame(edges, EDGES), []
    monkeypatch.setattr(prune, "materialize", lambda df, name, keep=prune.materialize: seen.append((name, keep(df, name))) or seen[-1][1])
    assert rows(prune.degree_cap_in_rounds(df, 3, 1, 100)) == rows(prune.degree_cap(df, 3))
    assert [n for n, _ in seen] == ["large", "open", "kept", "open"]
    assert [r["article_id"] for r in seen[0][1].collect()] == [9] and {r["article_id"] for r in seen[2][1].collect()} == {9}
    seen.clear()
    assert rows(prune.degree_cap_in_rounds(df, 3, 1, 200)) == rows(prune.degree_cap(df, 3)) and [n for n, _ in seen] == ["large"]


def test_a_large_article_is_many_tasks(spark):
    """Sixty thousand edges of one article: most are settled by rounds, in tasks by node, and equal the stream."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("article_id"), F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(5000)).cast("string")).alias("source"), F.concat(F.lit("n"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000)).cast("string")).alias("target"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100_000)) / 100_000).alias("score"))
    got, wanted = prune.degree_cap_in_rounds(df, 5), prune.degree_cap(df, 5)
    assert got.count() == wanted.count() and got.exceptAll(wanted).limit(1).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.37, 1.0])
def test_narrowing_finds_the_exact_percentile(spark, share):
    rng = random.Random(3)
    of = {1: [rng.random() for _ in range(500)], 2: [rng.randrange(4) / 4 for _ in range(333)], 3: [2.0 ** -rng.randrange(60) for _ in range(400)], 4: [0.5], 5: [0.1, 0.9], 6: [7.0] * 90, 7: [-5.0, 1e9, 3.0, 3.0, 4.5]}
    df = spark.createDataFrame([(a, "s", "t", x) for a, xs in of.items() for x in xs] + [(1, "s", "t", None), (8, "s", "t", None)], EDGES)
    for bins, few in ((16, 8), (1024, 4096)):
        got = {r["article_id"]: r["cut"] for r in prune.exact_cuts(df, share, bins, few).collect()}
        assert set(got) == set(of)
        for a, xs in of.items():
            assert got[a] == pytest.approx(np.percentile(xs, share * 100), rel=1e-12)


def test_percentile_of_large_and_small_articles(spark, sf):
    edges = prune.edges_of(Model(spark, sf))
    assert rows(prune.percentile_edges(edges, 0.7, large=3)) == rows(prune.percentile_edges(edges, 0.7))


# --- search ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark, sf, tmp_path_factory):
    extra = spark.createDataFrame([(-1, "Straße", "ÉCOLE 😀🎉 ab"), (-2, None, ""), (-3, "xy", None), (-4, "q", "needle in Hay")], "id long, title string, content string")
    texts = Model(spark, sf).texts.select("id", "title", "content").unionByName(extra).cache()
    found = search.TextIndex(spark, str(tmp_path_factory.mktemp("index")), "id", 32)
    found.write(texts, ["title", "content"])
    return found, texts


@pytest.mark.parametrize("term", ["idiot", "NEEDLE IN", "école", "😀🎉", "ab", "", "zzzzqq", "e th", "aße", "xyz"])
def test_search_equals_the_scan(index, term):
    found, texts = index
    scan = texts.where(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(term.lower())) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(term.lower())))
    assert sorted(r["id"] for r in found.search(texts, {"title": term, "content": term}).collect()) == sorted(r["id"] for r in scan.collect())


def test_search_reads_only_its_pieces(index):
    found, _ = index
    plan = found.candidates("content", "needle")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x or "Scan parquet" in x]
    assert scans and all("PartitionFilters: []" not in x and "PartitionFilters" in x for x in scans)
    assert "In(gram" in plan or "EqualTo(gram" in plan  # pushed to the row groups, which are sorted by gram
    assert [r["key"] for r in found.candidates("content", "needle").collect()] == [-4]


def test_grams_by_hand(spark):
    df = spark.createDataFrame([("AbCd",), ("ab",), ("",), (None,), ("😀é日x",), ("aaaa",)], "t string")
    assert [r[0] for r in df.select(search.grams(F.col("t"))).collect()] == [["abc", "bcd"], [], [], None, ["😀é日", "é日x"], ["aaa"]]
    assert search.term_grams("AbCd") == ["abc", "bcd"]


def test_postings_of_texts_that_lie_together_are_one_row(spark, tmp_path):
    texts = ["Abcabc", "", None, "ab", "xABCé", "😀é日x", "İab", "abc abc", "ABC"]
    df = spark.createDataFrame([(k // 2, t, "abc") for k, t in enumerate(texts)], "id long, t string, u string")
    index = search.TextIndex(spark, str(tmp_path), "id", 4)
    index.write(df.coalesce(1), ["t", "u"])
    stored = spark.read.parquet(f"{tmp_path}/postings")
    each = df.select(F.col("id").alias("key"), F.explode(search.grams(F.col("t"))).alias("gram"))
    assert rows(stored.where("field = 't'").select(F.explode("keys").alias("key"), "gram")) == rows(each)
    assert stored.where("field = 'u'").select("gram", F.size("keys").alias("n")).collect() == [("abc", len(texts))]
    assert {r["gram"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/counts").where("field = 't'").collect()} == {r["gram"]: r["count"] for r in each.groupBy("gram").count().collect()}
