"""Queries on tables whose articles are larger than the smallest tables have."""

import duckdb
import pytest
from test_oracles import normal

from lorekiln.operators import relational
from lorekiln.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """Tables in which article 5 has 30 entities, two of them in several lines."""
    path = tmp_path_factory.mktemp("large")
    duck = duckdb.connect()
    line = "5 AS l_orderkey, i % 30 AS l_partkey, 0 AS l_suppkey, CAST(i AS INTEGER) AS l_linenumber, CAST(1 + i * 7 % 50 AS DOUBLE) AS l_quantity, 'N' AS l_returnflag, 'O' AS l_linestatus"
    duck.sql(f"COPY (SELECT {line} FROM range(32) t(i)) TO '{path}/lineitem.parquet'")
    duck.sql(f"COPY (SELECT i AS p_partkey, CASE WHEN i % 2 = 0 THEN 'PROMO' ELSE 'SMALL' END AS p_type, 'blue ring' AS p_name FROM range(30) t(i)) TO '{path}/part.parquet'")
    return str(path)


def test_article_network_holds_all_edges_of_a_large_article(spark, large):
    duck = duckdb.connect()
    for t in ("lineitem", "part"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{large}/{t}.parquet'")
    got = QUERIES["g10b_article_network"](spark, large).select("article_id", "source", "target", "score").collect()
    wanted = duck.sql(f"SELECT article_id, source, target, score FROM ({ORACLES['g10b_article_network']})").fetchall()
    assert len(wanted) == 30 * 29 // 2 and normal(got) == normal(wanted)


@pytest.mark.parametrize("few", [0, 5, 64])
def test_containment_by_pairs_and_by_pieces(spark, few):
    schema = "article_id long, type string, name string"
    longs = [(k % 4, "AB"[k % 3 % 2], f"{'Old' if k % 2 else 'new'} Ring{k % 9} {'x' * (k % 4)}") for k in range(60)] + [(0, "A", None), (9, "A", "alone")]
    shorts = [(k % 4, "AB"[k % 2], n) for k, n in enumerate(["ring", "RING3", "", "x", "old", "xx", "nowhere", "new Ring4 ", None, "g1 ", "ring", "ring"] * 4)]
    got = relational.containment_matches(spark.createDataFrame(shorts, schema), spark.createDataFrame(longs, schema), few).collect()
    wanted = [(a, t, s, n) for a, t, s in shorts for b, u, n in longs if (a, t) == (b, u) and s is not None and n is not None and s.lower() in n.lower() and s != n]
    assert sorted(tuple(r) for r in got) == sorted(wanted) and wanted


def test_tasks_that_make_pairs_grow_in_number_with_the_input(spark):
    rows = [(k // 3, f"E{k % 7}", 0.5) for k in range(90)]
    facts = spark.createDataFrame(rows, "article_id long, entity string, confidence double")
    few, many = (relational.dealt(f, 10) for f in (facts.where("article_id < 10"), facts))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (3, 9)
    assert sorted(tuple(r) for r in many.collect()) == sorted(rows) and relational.dealt(facts.limit(0)).collect() == []
