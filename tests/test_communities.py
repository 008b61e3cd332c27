"""Corpus communities against the sequential form: modularity, names, and the same result in any order of rows."""

import random

import numpy as np
import pytest

from lorekiln.operators import communities, graph

EDGE = "source string, target string, score double"


def planted(rng, groups, each, inside, outside):
    """Edges of groups of nodes, denser inside."""
    out = []
    for i in range(groups * each):
        for j in range(i):
            if rng.random() < (inside if i // each == j // each else outside):
                out.append((f"n{j:03}", f"n{i:03}", 1.0 + rng.randrange(3)))
    return out


def score(edges, member):
    """Modularity by the definition."""
    nodes = sorted({x for e in edges for x in e[:2]})
    at = {n: k for k, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, s in edges:
        w[at[a], at[b]] += s
        w[at[b], at[a]] += s
    same = np.array([[member[a] == member[b] for b in nodes] for a in nodes])
    k = w.sum(axis=1)
    return float(((w - np.outer(k, k) / w.sum()) * same).sum() / w.sum()), nodes, w


@pytest.mark.parametrize("shape", [(6, 8, 0.5, 0.12)])
def test_modularity_near_the_sequential_form(spark, shape):
    rng = random.Random(11)
    edges = planted(rng, *shape)
    rows = communities.corpus_communities(spark.createDataFrame(edges, EDGE)).collect()
    member = {r["node"]: r["community"] for r in rows}
    mine, nodes, w = score(edges, member)
    theirs, *_ = score(edges, dict(zip(nodes, graph.louvain(w), strict=True)))
    assert set(member) == set(nodes) and mine >= 0.98 * theirs
    assert all(member[c] == c and c == min(n for n in member if member[n] == c) for c in member.values())
    links = graph.both_ways(spark.createDataFrame(edges, EDGE)).groupBy("source", "target").sum("score").toDF("source", "target", "w")
    found = spark.createDataFrame(list(member.items()), "node string, community string")
    assert communities.modularity(links, found, float(w.sum())) == pytest.approx(mine)


def test_same_result_in_any_order(spark):
    edges = planted(random.Random(3), 2, 6, 0.8, 0.1)
    turned = [(b, a, s) for a, b, s in reversed(edges)]
    one, two = (sorted(tuple(r) for r in communities.corpus_communities(spark.createDataFrame(e, EDGE).repartition(3)).collect()) for e in (edges, turned))
    assert one == two


def test_apart_groups_and_hard_rows(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 2.0), ("p", "q", 0.0), ("s", "s", 1.0), ("x", "y", 1.0)]
    got = {r["node"]: r["community"] for r in communities.corpus_communities(spark.createDataFrame(edges, EDGE)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "s": "s"}
    assert communities.corpus_communities(spark.createDataFrame([], EDGE)).collect() == []
