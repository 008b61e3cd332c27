"""Measures of stacked graphs against those of one graph after the other."""

import numpy as np
import pytest

from lorekiln.operators import graph, stacks

EDGE = "article_id long, source string, target string, score double"


def weights(rng, count, n):
    """Graphs of one size: dense and sparse, with equal weights, weights of nought, loops, parts that aren't connected."""
    out = []
    for k in range(count):
        w = np.triu(rng.integers(1, 6, (n, n)) / (1 if k % 2 else 10) * (rng.random((n, n)) < (1.0, 0.3, 0.6)[k % 3]), 0 if k % 5 == 0 else 1)
        out.append(w + w.T)
    out[0][:] = 0
    return np.stack(out)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 17])
@pytest.mark.parametrize("name", list(graph.MEASURES))
def test_stacked_as_one_by_one(n, name):
    w = weights(np.random.default_rng(n), 60, n)
    _, many, one = graph.MEASURES[name]
    assert np.allclose(many(w), np.stack([np.asarray(one(x)) for x in w]), rtol=1e-9, atol=1e-9)


def test_articles_across_batches_and_large_ones(spark):
    rng = np.random.default_rng(5)
    rows = []
    for article in range(400):
        n = 80 if article == 7 else int(rng.integers(2, 9))
        names = [f"é{i}" if i % 3 else f"z{i}" for i in range(n)]
        rows += [(article, names[i], names[j], float(rng.integers(1, 9)) / 8) for i in range(n) for j in range(i) if rng.random() < 0.7]
    rows += [rows[0], (rows[1][0], rows[1][2], rows[1][1], 0.5)]  # an edge twice, and one in the other direction
    edges = spark.createDataFrame(rows, EDGE)
    measures = [graph.MEASURES[n][1:] for n in ("pagerank", "degree", "place")]
    got = stacks.measured_graphs(edges.repartition(3), measures, "pagerank double, degree double, place array<double>", 50).collect()
    wanted = {}
    for article in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == article), key=lambda e: (-e[2], e[0], e[1]))
        nodes, w = graph._adjacency(mine)
        wanted |= {(article, v): (p, d, *at) for v, p, d, at in zip(nodes, graph.pagerank(w), w.sum(axis=1) / w.sum(axis=1).max(), graph.spring_layout(w), strict=True)}
    assert len(got) == len(wanted)
    assert all(np.allclose((r["pagerank"], r["degree"], *r["place"]), wanted[r["article_id"], r["node"]], atol=1e-9) for r in got)
    assert stacks.measured_graphs(edges.limit(0), measures, "pagerank double, degree double, place array<double>").collect() == []
