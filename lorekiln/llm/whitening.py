"""Embedding whitening by a one-sided Jacobi SVD of a tall matrix that no task ever holds.

Vectors become whole numbers first (floor(SCALE * c) + OFFSET), so that their count and sums are exact.  Each task
reduces its centred rows block by block to a triangle R by QR (a block goes below the R so far), triangles meet FAN
at a time in further rounds, and the last one is that of all centred rows.  Plane rotations then make R's columns
orthogonal; the columns' lengths over sqrt(n) are the standard deviations, the accumulated rotations the components.
No covariance is formed on that way, so small deviations keep their digits.  What travels is one triangle a task,
d x d numbers; the last one is of that size whatever the number of rows.  The identity error is measured on the
whitened rows themselves, in a pass that sums their products.

Cases: null vectors, and vectors with null or non-finite entries, are dropped.  The dimension is that of most of the
rest (ties: the larger); vectors of another length, and empty ones, are dropped as well.  Entries beyond 2^50 and
deviations beyond 64 bits raise an ArithmeticError: a long can't hold them.  A component without variance (equal
rows, a single row, dependent dimensions) has null whitened values and explains 0; it is left out of the identity
error, which is 0 where there is no other.  Equal eigenvalues: any orthonormal components.  A component's entry of
largest size is positive.  Repeated rows count each, a null vec_id is a row like any other.  No rows left: no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, release

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows that a task turns into numbers at a time, and triangles that meet in one.
ROWS, FAN = 4096, 16
SWEEPS = 60
LONG = 2**63 - 1


class Model(NamedTuple):
    """The fit: rows, sums, components as columns, their standard deviations (0: none), and the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    total: float


def _usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the vectors whose entries are all there and finite."""
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN counts as larger than infinity
    return vectors.where((F.size("vector") > 0) & finite)


def whole(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of whole numbers."""
    c = np.asarray(column.flatten()).reshape(len(column), -1)
    if c.size and np.abs(c).max() >= 2.0**50:
        raise ArithmeticError("an entry beyond 2^50 has no whole number of 64 bits")
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the whole part of S/n is taken off exactly."""
    return (x - sums // n) - (sums % n) / n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length the task's rows and their sums by dimension."""
    held: dict[int, list] = {}
    for batch in batches:
        for part in pieces(batch, ROWS):
            lengths = np.asarray(part.column("vector").value_lengths())
            for d in np.unique(lengths):
                x = whole(part.column("vector").filter(pa.array(lengths == d)))
                n, s = held.get(int(d), (0, [0] * int(d)))
                held[int(d)] = [n + len(x), [a + b for a, b in zip(s, x.sum(axis=0).tolist(), strict=True)]]
    if held:
        rows = [(d, n, s) for d, (n, s) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ("int32", "int64", pa.list_(pa.int64())), strict=True)], ["d", "n", "sums"])


def counted(vectors: DataFrame) -> tuple[int, int, np.ndarray] | None:
    """The dimension, rows of it and their sums; None without rows.  What is collected is of the dimension's size."""
    parts = materialize(vectors.select("vector").mapInArrow(_sums, "d int, n long, sums array<long>"), "sums")
    top = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    sums = parts.where(F.col("d") == top["d"]).select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
    release(parts)
    return top["d"], top["n"], np.array([r["s"] for r in sorted(sums, key=lambda r: r["k"])], np.int64)


def gathered(rows: DataFrame, add: Callable, name: str) -> np.ndarray:
    """One array out of the tasks' arrays (column ``a``, bytes of doubles): FAN and more meet in a task, round by round."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for raw in batch.column("a"):
                a = np.frombuffer(raw.as_py())
                held = a if held is None else add(held, a)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], "binary")], ["a"])

    held = materialize(rows, name)
    n = held.count()
    while n > 1:
        tasks = -(-n // FAN)
        fewer = materialize(held.repartition(tasks).mapInArrow(meet, "a binary"), name)
        release(held)
        held, n = fewer, fewer.count()
    out = np.frombuffer(held.first()["a"])
    release(held)
    return out


def triangle(above: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of ``rows`` below the triangle so far."""
    return np.linalg.qr(rows if above is None else np.vstack([above, rows]), mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, lengths): rotations V that make R's columns orthogonal, and the lengths of R V's columns, longest first.

    A sweep turns every pair of columns once; its rounds pair all columns off, so that a round's rotations are
    independent and done at once.
    """
    d = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    a, v = r[:, order].copy(), np.eye(d)[:, order]
    seats = list(range(d)) + [-1] * (d % 2)
    half = len(seats) // 2
    limit = np.finfo(float).eps * np.sqrt(d)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(1, len(seats) - 1)):
            pairs = [(p, q) for p, q in zip(seats[:half], seats[: half - 1 : -1], strict=True) if p >= 0 and q >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            open_ = np.abs(gamma) > limit * np.sqrt(alpha) * np.sqrt(beta)
            if not open_.any():
                continue
            turned, p, q = True, p[open_], q[open_]
            zeta = (beta[open_] - alpha[open_]) / (2 * gamma[open_])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    lengths = np.linalg.norm(a, axis=0)
    order = np.argsort(-lengths, kind="stable")
    v = v[:, order]
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0), lengths[order]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as whole numbers."""
    for batch in batches:
        for part in pieces(batch, ROWS):
            yield part, whole(part.column("vector"))


def fit(vectors: DataFrame, n: int, sums: np.ndarray) -> Model:
    """The model of ``vectors`` (of one length), of which ``n`` and ``sums`` are known."""
    d = len(sums)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _rows(batches):
            r = triangle(r, centred(x, n, sums))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], "binary")], ["a"])

    add = lambda a, b: triangle(a.reshape(-1, d), b.reshape(-1, d)).ravel()
    r = gathered(vectors.select("vector").mapInArrow(reduce, "a binary"), add, "triangles").reshape(-1, d)
    v, lengths = jacobi(r)
    # Below this the lengths are the rounding of QR: no variance.
    lengths = np.where(lengths > (lengths.max(initial=0.0) * 4 * d * np.finfo(float).eps), lengths, 0.0)
    return Model(n, sums, v, lengths / np.sqrt(n), float((lengths**2).sum() / n))


def projected(x: np.ndarray, model: Model, k: int) -> np.ndarray:
    """The first ``k`` whitened values of each row; NaN where a component has no variance."""
    s = model.deviations[:k]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s > 0, centred(x, model.n, model.sums) @ model.components[:, :k] / s, np.nan)


def identity_error(vectors: DataFrame, model: Model, k: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity, over the components that have variance."""
    kept = int((model.deviations[:k] > 0).sum())
    if not kept:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((kept + 1, kept))
        for _, x in _rows(batches):
            w = projected(x, model, kept)
            held += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], "binary")], ["a"])

    held = gathered(vectors.select("vector").mapInArrow(moments, "a binary"), np.add, "moments").reshape(kept + 1, kept)
    mean = held[-1] / model.n  # zero but for rounding: the rows are centred
    return float(np.abs(held[:-1] / model.n - np.outer(mean, mean) - np.eye(kept)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum over dimensions of (n x - S)^2, exact."""
    q, r = sums // n, sums % n
    far = x - q
    bound = (float(np.abs(far).max(initial=0)) + 1) * n
    if bound**2 * x.shape[1] < 2.0**62:
        return ((far * n - r) ** 2).sum(axis=1).tolist()
    out = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, r, strict=True)) for row in far]
    if max(out, default=0) > LONG:
        raise ArithmeticError("a deviation has more than 64 bits")
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation and whitened (array of up to ``components`` values) of each row, with n, explained (array) and identity_error of the fit."""
    vectors = _usable(embeddings)
    kind = dict(embeddings.dtypes)["vec_id"]
    known = counted(vectors)
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    if known is None:
        return embeddings.sparkSession.createDataFrame([], f"{schema}, n long, explained array<double>, identity_error double")
    d, n, sums = known
    vectors = vectors.where(F.size("vector") == d)
    model = fit(vectors, n, sums)
    k = min(components, d)
    error = identity_error(vectors, model, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _rows(batches):
            w = projected(x, model, k).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k), "int32"), pa.array(w, mask=np.isnan(w)))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviations(x, n, sums), "int64"), lists], ["vec_id", "deviation", "whitened"])

    explained = [float(s**2 / model.total) if model.total else 0.0 for s in model.deviations[:k]]
    out = vectors.mapInArrow(run, schema)
    return out.withColumns({"n": F.lit(n).cast("long"), "explained": F.array(*[F.lit(e) for e in explained]), "identity_error": F.lit(error)})


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    each = whitened.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "value"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.element_at("explained", F.col("k") + 1).alias("explained"), "identity_error")
