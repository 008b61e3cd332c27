"""Exact top-k search by inner product over norm buckets.

Vectors are ordered by length and cut into buckets.  A first look into the bucket of longest vectors
gives each query a lower bound on its k-th score.  A bucket is visited by a block of queries only where
some bound can be reached; there each query has a local cosine threshold, its bound over the product of
its length and the bucket's largest.  Below COORDINATE_FROM the bucket's prefix of sufficient length is
taken; above it, the vectors whose share along the query's largest coordinate is feasible.  Products of
all candidates left are verified exactly, in integers.

Neighbouring buckets form chunks, and a task holds one chunk, through which the blocks of queries stream
that may find something in it: a bucket's matrix is shuffled once, a query's once for each chunk it visits,
never for each pair of blocks.  A query goes through a chunk's buckets from the longest on, and what it
finds raises its bound for those that follow; what leaves the task are its k best of the chunk.

Cases: vectors that are null, empty, or hold null or non-finite components take no part.  Vectors of
different dimension aren't compared.  A query is compared with no row of its own vec_id; queries that
repeat a vec_id with another vector have lists of their own, equal ones are one.  Ties go to the
smaller vec_id, equal rows may both be listed.  Fewer candidates than k give them all.  Rows without
vec_id are left out.  An empty table gives no rows.  Scores are 64-bit integers: products that leave them
raise an OverflowError and components of 2^62 or more an error of Spark's; nothing wraps or saturates.  Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, materialize

SCALE = 256
QUERY_MODULUS = 50
K = 5
BUCKET_ROWS = 8192
BLOCK_ROWS = 1024
#: Buckets of a chunk at most: with 64 dimensions 64 MB.
CHUNK_BUCKETS = 16
#: Local cosine thresholds from which pruning by a coordinate is worth its lookups.
COORDINATE_FROM = 0.6
EXACT, WHOLE = 2.0**53, 2.0**62


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (integers), dim and norm of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    # The cast of a double to a long saturates instead of failing.
    far = F.raise_error(F.lit("a component beyond 2^62 has no product of 64 bits")).cast("long")
    component = lambda e: F.when(F.abs(F.floor(e * scale).cast("double")) < WHOLE, F.floor(e * scale).cast("long")).otherwise(far)
    rows = rows.select("vec_id", F.transform(x, component).alias("v"))
    return rows.withColumns({"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))})


def _packed(rows: DataFrame, limit: int) -> DataFrame:
    """Partitions of (vec_id, v, dim, norm) as blocks of at most ``limit`` rows of one dimension, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            flat, offsets = b.column("v").values.to_numpy(), b.column("v").offsets.to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = flat[(offsets[at][:, None] + np.arange(d)[None, :])]
                by_dim.setdefault(int(d), []).append((b.column("vec_id").to_numpy()[at], v, b.column("norm").to_numpy()[at]))
        for d, parts in by_dim.items():
            ids, v, norms = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids, -norms))
            for i in range(0, len(order), limit):
                o = order[i : i + limit]
                block = f"{d}/{ids[o[0]]}/{norms[o[0]]:.6f}/{i}/{len(order)}/{norms[o[-1]]:.6f}/{ids[o[-1]]}"
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "dim": pa.array([d], pa.int32()), "longest": [float(norms[o[0]])], "ids": [ids[o].astype("<i8").tobytes()], "matrix": [v[o].astype("<i8").tobytes()]}
                )

    return rows.select("vec_id", "v", "dim", "norm").mapInArrow(run, "block string, dim int, longest double, ids binary, matrix binary")


def _opened(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<i8").reshape(-1, dim)


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(axis=1))


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where every sum stays below 2^53, unbounded ones where it may leave 64 bits."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(p.astype(float)).max(initial=0)) * q.shape[-1]
    if most < EXACT:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    if most < WHOLE:
        return q @ p.T
    table = q.astype(object) @ p.astype(object).T
    if any(abs(x) >= 2**63 for x in table.flat):
        raise OverflowError("an inner product leaves 64 bits")
    return table.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_bucket(query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, candidates' places, scores) for the queries that may find one of their k best in a bucket."""
    lengths, reach = _lengths(p), _lengths(q)
    along: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    plain: list[tuple[int, int]] = []
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(bounds > 0, bounds / reach, 0.0) * (1 - 1e-9)
    for i in np.flatnonzero(need <= lengths[0]):
        cosine = need[i] / lengths[0] if lengths[0] else 0.0
        prefix = int(np.searchsorted(-lengths, -need[i], "right"))
        if cosine < COORDINATE_FROM:
            plain.append((prefix, i))
            continue
        f = int(np.argmax(np.abs(q[i])))
        if f not in along:
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(lengths > 0, p[:, f] / lengths, 0.0)
            order = np.argsort(share)
            along[f] = order, share[order]
        order, share = along[f]
        x = q[i, f] / reach[i]
        slack = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - x * x))) + 1e-9
        low, high = (np.searchsorted(share, x * cosine - slack), np.searchsorted(share, x * cosine + slack, "right")) if abs(x) < cosine else ((np.searchsorted(share, x * cosine - slack), len(share)) if x > 0 else (0, np.searchsorted(share, x * cosine + slack, "right")))
        at = order[low:high]
        at = at[(at < prefix) & (ids[at] != query_ids[i])]
        if len(at):
            scores = products(q[i : i + 1], p[at])[0]
            top = best(scores, ids[at], k)
            yield i, at[top], scores[top]
    plain.sort()
    for start in range(0, len(plain), 128):
        group = plain[start : start + 128]
        table = products(q[[i for _, i in group]], p[: group[-1][0]])
        for (prefix, i), row in zip(group, table, strict=True):
            at = np.flatnonzero(ids[:prefix] != query_ids[i])
            if len(at):
                top = best(row[at], ids[at], k)
                yield i, at[top], row[at][top]


def _bounds(blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The query blocks with their bounds: the k-th best score in the bucket of the longest vectors (-2^63: fewer than k)."""
    seed = buckets.groupBy("dim").agg(F.max_by("block", F.struct("longest", "block")).alias("block"))
    seed = buckets.join(seed, ["dim", "block"], "left_semi").select("dim", F.col("ids").alias("seed_ids"), F.col("matrix").alias("seed_matrix"))

    def make() -> Callable[..., list[list]]:
        def run(block: list, dim: list, ids: list, matrix: list, seed_ids: list, seed_matrix: list) -> list[list]:
            bounds, need = [], []
            for d, i, m, si, sm in zip(dim, ids, matrix, seed_ids, seed_matrix, strict=True):
                (qi, q), (pi, p) = _opened(i, m, d), _opened(si, sm, d)
                low = np.full(len(qi), np.iinfo(np.int64).min)
                for at, _, scores in search_bucket(qi, q, low, pi, p, k):
                    if len(scores) == k:
                        low[at] = scores[-1]
                reach = _lengths(q)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need.append(float(np.where((low > 0) & (reach > 0), low / reach, 0.0).min() * (1 - 1e-9)))
                bounds.append(low.astype("<i8").tobytes())
            return [block, dim, ids, matrix, bounds, need]

        return run

    joined = blocks.join(seed, "dim").select("block", "dim", "ids", "matrix", "seed_ids", "seed_matrix")
    return map_columns(joined, make, "qblock string, dim int, ids binary, matrix binary, bounds binary, need double", rows=1)


class Held:
    """The buckets of a chunk, longest first, that a task holds while queries pass."""

    def __init__(self, k: int):
        self.k = k
        self.buckets: list[tuple[float, np.ndarray, np.ndarray]] = []

    def ask(self, query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, vec_ids, scores) of the k best of the chunk for each query that finds any."""
        low, reach = bounds.copy(), _lengths(q)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for longest, ids, p in self.buckets:
            with np.errstate(divide="ignore", invalid="ignore"):
                if not (np.where(low > 0, low / reach, 0.0) * (1 - 1e-9) <= longest).any():
                    continue
            for i, places, scores in search_bucket(query_ids, q, low, ids, p, self.k):
                here = ids[places]
                if i in found:
                    here, scores = np.concatenate((found[i][0], here)), np.concatenate((found[i][1], scores))
                    top = best(scores, here, self.k)
                    here, scores = here[top], scores[top]
                found[i] = here, scores
                if len(scores) == self.k:
                    low[i] = max(low[i], scores[-1])
        for i, (here, scores) in found.items():
            yield i, here, scores


def _found(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The results of the queries that follow a chunk's buckets in a sorted partition."""
    at, held = None, Held(k)
    for batch in batches:
        for r in range(batch.num_rows):
            chunk, dim, side, longest, ids, matrix, bounds = (c[r].as_py() for c in batch.columns)
            if (chunk, dim) != at:
                at, held = (chunk, dim), Held(k)
            place, m = _opened(ids, matrix, dim)
            if side == 0:
                held.buckets.append((longest, place, m))
                continue
            out: list[list] = [[], [], [], []]
            for i, here, scores in held.ask(place, m, np.frombuffer(bounds, "<i8")):
                key = xxhash.xxh3_64_intdigest(m[i].tobytes()) >> 1
                for column, values in zip(out, ([int(place[i])] * len(here), [key] * len(here), here.tolist(), scores.tolist()), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, "int64") for c in out], ["query_id", "key", "vec_id", "score"])


def search(vectors: DataFrame, k: int = K, modulus: int = QUERY_MODULUS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each vector whose id ``modulus`` divides, against all others."""
    rows = materialize(quantized(vectors, scale), "vectors")
    n = max(1, -(-rows.count() // BUCKET_ROWS))
    chunk = max(1, min(CHUNK_BUCKETS, n // vectors.sparkSession.sparkContext.defaultParallelism))
    # Partitions follow the order of lengths, so neighbouring ones make a chunk.
    packed = _packed(rows.repartitionByRange(n, "dim", F.desc("norm"), "vec_id"), BUCKET_ROWS).withColumn("chunk", F.floor(F.spark_partition_id() / chunk).cast("int"))
    buckets = materialize(packed, "buckets")
    asked = rows.where(F.col("vec_id") % modulus == 0).dropDuplicates(["vec_id", "v"])
    blocks = _packed(asked.repartition(max(1, -(-n * BUCKET_ROWS // modulus // BLOCK_ROWS)), F.xxhash64("vec_id")), BLOCK_ROWS)
    blocks = materialize(_bounds(blocks, buckets, k), "queries")
    # Only headers meet here.
    chunks = buckets.groupBy("dim", "chunk").agg(F.max("longest").alias("longest"))
    visits = blocks.select("qblock", "dim", "need").join(chunks, "dim").where("need <= longest").groupBy("qblock").agg(F.collect_list("chunk").alias("chunks"))
    guests = blocks.join(visits, "qblock").select(F.explode("chunks").alias("chunk"), "dim", F.lit(1).alias("side"), F.lit(0.0).alias("longest"), "ids", "matrix", "bounds")
    hosts = buckets.select("chunk", "dim", F.lit(0).alias("side"), "longest", "ids", "matrix", F.lit(None).cast("binary").alias("bounds"))
    both = hosts.unionByName(guests).repartition(max(1, -(-n // chunk)), "chunk", "dim").sortWithinPartitions("chunk", "dim", "side", F.desc("longest"))
    found = both.mapInArrow(lambda batches: _found(batches, k), "query_id long, key long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
