"""Measures of many small graphs at once: graphs of one size are stacked, and each step of a measure is one array operation.

The results are those of the functions of ``graph`` on one graph after the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

DAMPING = 0.85
#: Edges that are stacked at a time, cells (nodes cubed) of a stack, and the nodes from which a graph is worked on alone.
EDGES, CELLS, SMALL = 1 << 16, 1 << 17, 64


def pagerank(w: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Each graph stops in its own round."""
    n = w.shape[1]
    out = w.sum(axis=2, keepdims=True)
    p = np.where(out > 0, w / np.where(out > 0, out, 1), 1 / n).transpose(1, 2, 0).copy()
    r = np.full((n, len(w)), 1 / n)
    ranks = r.copy()
    open_ = np.arange(len(w))
    for _ in range(rounds):
        after = (1 - DAMPING) / n + DAMPING * (r[:, None] * p).sum(axis=0)
        ranks[:, open_] = after
        still = np.abs(after - r).sum(axis=0) >= n * tolerance
        if not still.all():
            open_, after, p = open_[still], after[:, still], p[:, :, still]
            if not len(open_):
                break
        r = after
    return ranks.T


def degree(w: np.ndarray) -> np.ndarray:
    sums = w.sum(axis=2)
    top = sums.max(axis=1, keepdims=True)
    return sums / np.where(top == 0, 1, top)


def eigenvector(w: np.ndarray, rounds: int = 100) -> np.ndarray:
    turned = w.transpose(2, 1, 0).copy()  # by column, row and graph
    x = np.full((w.shape[1], len(w)), 1 / math.sqrt(w.shape[1]))
    for _ in range(rounds):
        x = x + (turned * x[:, None]).sum(axis=0)
        size = np.sqrt((x * x).sum(axis=0))
        x = x / np.where(size == 0, 1, size)
    return np.where(w.any(axis=(1, 2))[:, None], x.T, w.sum(axis=2))


def betweenness(w: np.ndarray) -> np.ndarray:
    """Dijkstra's order and path counts from all nodes of all graphs in step, then Brandes' accumulation backwards."""
    n, graphs = w.shape[1], np.arange(len(w))
    w = w.transpose(1, 2, 0)
    with np.errstate(all="ignore"):
        cost = np.where(w > 0, 1 / (w + 0.01), np.inf)
    every = np.arange(n)[None, :, None]
    at = lambda a, v: np.take_along_axis(a, v[:, None], axis=1)
    start = np.repeat(np.eye(n)[:, :, None], len(graphs), axis=2)
    dist, paths, place = np.where(start > 0, 0.0, np.inf), start.copy(), np.full(start.shape, n)
    order = []
    with np.errstate(invalid="ignore"):  # inf - inf: not reached, and not equal
        for k in range(n):
            left = np.where(place < n, np.inf, dist)
            v = left.argmin(axis=1)  # by start and graph; the first of equals, as in a heap of (distance, node)
            d = at(left, v)
            order.append((v, d < np.inf))
            place = np.where((every == v[:, None]) & (d < np.inf), k, place)
            found = d + cost[v[:, None], every, graphs]
            better = found < dist - 1e-12
            equal = ~better & (np.abs(found - dist) <= 1e-12) & (place == n)
            paths = np.where(better, at(paths, v), paths + np.where(equal, at(paths, v), 0))
            dist = np.where(better, found, dist)
        share = np.zeros(start.shape)
        for v, reached in reversed(order):
            mine = at(place, v)
            before = reached & (place < mine) & (np.abs(dist + cost[every, v[:, None], graphs] - at(dist, v)) <= 1e-12)
            count = at(paths, v)
            share = share + np.where(before, paths / np.where(count == 0, 1, count) * (1 + at(share, v)), 0)
    score = np.where(start > 0, 0, share).sum(axis=0).T
    return score / ((n - 1) * (n - 2)) if n > 2 else score


def _renumbered(member: np.ndarray) -> np.ndarray:
    """Communities numbered by their first node."""
    first = (member[:, :, None] == member[:, None]).argmax(axis=2)
    return np.take_along_axis(np.cumsum(first == np.arange(member.shape[1]), axis=1) - 1, first, axis=1)


def _moved(graph: np.ndarray, total: np.ndarray, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """Each node's community after moves, nodes in order, until a pass moves none; and whether any moved."""
    count, n = graph.shape[:2]
    owns, volumes, changed = np.tile(np.arange(n), (count, 1)), graph.sum(axis=2), np.zeros(count, bool)
    open_ = np.arange(count)
    while len(open_):
        g, own, volume, all_, r = graph[open_], owns[open_], volumes[open_], total[open_, None], np.arange(len(open_))
        strength, moved = g.sum(axis=2), np.zeros(len(open_), bool)
        for v in range(n):
            home, k = own[:, v].copy(), strength[:, v]
            volume[r, home] -= k
            links = np.zeros((len(open_), n))
            for u in range(n):
                if u != v:
                    links[r, own[:, u]] += g[:, v, u]
            gain = links - resolution * k[:, None] * volume / all_
            reached = links > 0
            best = np.where(reached.any(axis=1), np.where(reached, gain, -np.inf).argmax(axis=1), home)
            goes = gain[r, best] > gain[r, home] + 1e-12
            own[:, v] = np.where(goes, best, home)
            volume[r, own[:, v]] += k
            moved |= goes
        owns[open_], volumes[open_] = own, volume
        changed[open_[moved]] = True
        open_ = open_[moved]
    return owns, changed


def louvain(w: np.ndarray, resolution: float = 1.0) -> np.ndarray:
    count, n = w.shape[:2]
    member = np.tile(np.arange(n), (count, 1))
    total = np.ascontiguousarray(w).reshape(count, -1).sum(axis=1)
    some = np.flatnonzero(total)
    levels = [(some, w[some])]
    while levels:
        which, graph = levels.pop()
        own, changed = _moved(graph, total[which], resolution)
        which, graph, own = which[changed], graph[changed], _renumbered(own[changed])
        member[which] = np.take_along_axis(own, member[which], axis=1)
        sizes = own.max(axis=1, initial=0) + 1
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            join = np.zeros((len(mine), graph.shape[1], size))
            join[np.arange(len(mine))[:, None], np.arange(graph.shape[1]), own[mine]] = 1
            levels.append((which[mine], join.transpose(0, 2, 1) @ graph[mine] @ join))
    return _renumbered(member)


def communities_of(w: np.ndarray, resolution: float = 1.0, smallest: int = 2) -> np.ndarray:
    member = louvain(w, resolution)
    return np.where((member[:, :, None] == member[:, None]).sum(axis=2) >= smallest, member, -1)


def spring_layout(w: np.ndarray, rounds: int = 50, seed: int = 42) -> np.ndarray:
    count, n = w.shape[:2]
    if n == 1:
        return np.zeros((count, 1, 2))
    at = np.repeat(np.random.default_rng(seed).uniform(-1, 1, (n, 2)).T[:, :, None], count, axis=2)  # by axis, node and graph
    k, w = 1 / math.sqrt(n), w.transpose(1, 2, 0).copy()
    for i in range(rounds):
        gap = at[:, :, None] - at[:, None]
        far = np.maximum(np.sqrt(gap[0] * gap[0] + gap[1] * gap[1]), 0.01)
        push = (gap * (k * k / far**2 - w * far / k)).sum(axis=2)
        size = np.maximum(np.sqrt(push[0] * push[0] + push[1] * push[1]), 1e-9)
        at = at + push / size * np.minimum(size, 0.1 * (1 - i / rounds))
    at = at - at.mean(axis=1, keepdims=True)
    return (at / np.maximum(1e-9, np.abs(at).max(axis=(0, 1)))).transpose(2, 1, 0)


Measure = Callable[[np.ndarray], np.ndarray]


def _chunks(batches: Iterator[pa.RecordBatch], edges: int) -> Iterator[pa.Table]:
    """Whole articles, of about so many edges together, from a stream that is sorted by article."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and sum(h.num_rows for h in held) >= edges:
            ids = pa.concat_arrays([held[-1].column(0)[-1:], b.column(0)]).dictionary_encode("encode").indices.to_numpy()
            starts = np.flatnonzero(np.diff(ids))
            if len(starts):
                yield pa.Table.from_batches([*held, b.slice(0, starts[-1])])
                held, b = [], b.slice(starts[-1])
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _measured(table: pa.Table, measures: list[tuple[Measure, Measure]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    if table.column(3).null_count:
        raise ValueError("an edge without a score")
    article, score = table.column(0).combine_chunks(), table.column(3).to_numpy()
    graph = np.concatenate([[0], np.cumsum(np.diff(article.dictionary_encode("encode").indices.to_numpy()) != 0)])
    first = np.flatnonzero(np.diff(graph, prepend=-1))
    ends = pa.concat_arrays([table.column(c).combine_chunks() for c in (1, 2)]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # A graph's nodes are numbered by name.
    nodes, where = np.unique(np.tile(graph, 2) * len(order) + rank[ends.indices.to_numpy()], return_inverse=True)
    sizes = np.bincount(nodes // len(order), minlength=len(first))
    start = np.cumsum(sizes) - sizes
    s, t = (where - start[np.tile(graph, 2)]).reshape(2, -1)
    names = ends.dictionary.take(pa.array(order[nodes % len(order)]))
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        edges = np.flatnonzero(sizes[graph] == n)  # in order of graphs
        step = max(1, CELLS // n**3)
        for low in range(0, len(which), step):
            some = which[low : low + step]
            mine = edges[np.searchsorted(graph[edges], some[0]) : np.searchsorted(graph[edges], some[-1], "right")]
            w = np.zeros((len(some), n, n))
            of, a, b = np.searchsorted(some, graph[mine]), s[mine], t[mine]
            np.add.at(w, (np.repeat(of, 2), np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel()), np.repeat(score[mine], 2))
            found = [many(w) if n <= SMALL else np.stack([np.asarray(one(x)) for x in w]) for many, one in measures]
            columns = [article.take(pa.array(np.repeat(first[some], n))), names.take(pa.array((start[some, None] + np.arange(n)).ravel()))]
            for values, kind in zip(found, arrow.types[2:], strict=True):
                flat = pa.array(np.ascontiguousarray(values).ravel())
                if pa.types.is_list(kind):
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, values.shape[2]), pa.int32()), flat)
                columns.append(flat)
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, arrow.types, strict=True)], schema=arrow)


def measured_graphs(edges: DataFrame, measures: list[tuple[Measure, Measure]], schema: str, together: int = EDGES) -> DataFrame:
    """(article_id, node) and the ``measures`` of each article's graph, of stacks of small graphs and of one large graph.

    One shuffle brings articles together, sorted; a task holds the edges of a stack, or of one article if it has more.
    """
    rows = edges.select("article_id", "source", "target", F.col("score").cast("double").alias("score"))
    sorted_ = rows.repartition("article_id").sortWithinPartitions("article_id", F.desc("score"), "source", "target")
    fields = T.StructType.fromDDL(f"article_id {dict(rows.dtypes)['article_id']}, node string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)
        for table in _chunks(batches, together):
            yield from _measured(table, measures, arrow)

    return sorted_.mapInArrow(run, fields)
