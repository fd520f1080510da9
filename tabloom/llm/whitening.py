"""Whitening of vectors by their principal components, from a polar decomposition.

The covariance is summed by blocks of rows of the table, each centred before it
is multiplied. Its eigenvectors are found by spectral division: the covariance
less a shift has a polar factor, whose eigenvalues are 1 above the shift and -1
below, so half its sum with the identity is the projector on the subspace of the
larger eigenvalues. The matrix falls apart into two smaller ones on that subspace
and its complement, which are divided in turn until single components are left.
The polar factor comes from dynamically weighted Halley steps (QDWH), six at most
for any condition. The components go to all tasks, which whiten the rows.

What the driver holds is one matrix as wide as a vector is long, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import col

STEP_ROWS = 4096
# rows of partial sums that one task adds up
FAN = 512
EPS = np.finfo(float).eps
LIMIT = float(1 << 62)


# the small dense matrices


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without zero eigenvalues."""
    n = len(a)
    x = a / np.linalg.norm(a)
    r = np.linalg.qr(x, mode="r")
    # a lower bound of the singular values
    low = 1.0 / max(np.linalg.norm(np.linalg.inv(r + np.diag(np.where(np.diag(r) == 0, EPS, 0.0)))), 1.0)
    low = min(max(low, EPS), 1.0)
    eye = np.eye(n)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            after = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            after = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        after = (after + after.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved = np.linalg.norm(after - x)
        x = after
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(5 * EPS):
            break
    return x


def _divided(a: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the eigenvectors above ``shift``, and their number."""
    n = len(a)
    moved = a - shift * np.eye(n)
    if np.linalg.norm(moved) <= EPS * scale:
        return None
    projector = (polar_factor(moved) + np.eye(n)) / 2
    above = round(float(np.trace(projector)))
    if not 0 < above < n:
        return None
    basis = np.random.default_rng(n).standard_normal((n, n))
    for _ in range(3):
        basis[:, :above] = projector @ basis[:, :above]
        basis[:, above:] -= projector @ basis[:, above:]
        basis = np.linalg.qr(basis)[0]
    rest = np.linalg.norm(basis[:, :above].T @ a @ basis[:, above:])
    return (basis, above) if rest <= 50 * n * EPS * scale else None


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)
    values, vectors = np.zeros(len(a)), np.zeros_like(a)
    done = 0
    left = [(a, np.eye(len(a)))]
    while left:
        block, basis = left.pop()
        n = len(block)
        mean = np.trace(block) / max(n, 1)
        spread = np.linalg.norm(block - mean * np.eye(n))
        if n <= 1 or spread <= n * EPS * scale:  # any basis of an eigenspace will do
            values[done : done + n] = np.diag(block)
            vectors[:, done : done + n] = basis
            done += n
            continue
        # the mean lies within the spectrum; other shifts in case an eigenvalue is too near
        shifts = [float(np.median(np.diag(block))), mean, *[mean + spread * f / (2 * n) for f in (0.37, -0.37, 0.11, -0.11, 0.71, -0.71, 0.05, -0.05)]]
        for shift in shifts:
            found = _divided(block, shift, scale)
            if found:
                break
        else:
            raise RuntimeError("no shift divides the spectrum")
        turn, above = found
        whole = turn.T @ block @ turn
        whole = (whole + whole.T) / 2
        for part in (slice(0, above), slice(above, n)):
            left.append((whole[part, part], basis @ turn[:, part]))
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.linalg.norm(vectors, axis=0)
    # either sign is right; the one with the largest entry positive is the same in every run
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))]) if len(a) else np.ones(0)
    return values[order], vectors * sign


# the table


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: entry(c.cast("double"))), F.lit(False))


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Columns id and x: entries c of the usable vectors as whole numbers floor(scale * c) + shift.

    A vector that is null, without entries, or holds a null or non-finite entry is left out.
    """
    given = vectors.where(usable(col(vector_col))).select(col(id_col).alias("id"), col(vector_col).alias("v"))
    return given.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for first in range(0, whole.num_rows, STEP_ROWS):
            batch = whole.slice(first, STEP_ROWS)
            lists = batch.column(batch.schema.get_field_index("x"))
            yield batch, lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task and length of a vector: rows, and the sum of each entry."""
    found: dict[int, list] = {}
    for whole in batches:
        lists = whole.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        for size in np.unique(sizes).tolist():
            own = lists.filter(pa.array(sizes == size))
            x = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            if len(x) * np.abs(x.astype(float)).max() >= LIMIT:
                raise OverflowError("entries are too large to add up exactly")
            held = found.setdefault(size, [0, [0] * size])
            held[0] += len(x)
            held[1] = [a + b for a, b in zip(held[1], x.sum(0).tolist())]
    for size, (rows, sums) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([sums], pa.list_(pa.int64()))], ["n", "sums"])


def _products(of: Callable[[np.ndarray], np.ndarray]):
    """Sums and products of the columns of ``of(x)`` over the rows of a task, a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for _, x in _matrices(batches):
            made = of(x)
            made = np.column_stack([np.ones(len(made)), made])
            total = made.T @ made + (0 if total is None else total)
        if total is not None:
            n = len(total)
            task = TaskContext.get().partitionId() // FAN
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "task", "row"]
            )

    return run


def _added(table: pa.Table) -> pa.Table:
    rows = table["row"].combine_chunks()
    whole = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(0)
    return pa.Table.from_arrays([table["i"].slice(0, 1), pa.array([whole.tolist()], pa.list_(pa.float64()))], names=["i", "row"])


def products(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The matrix of sums of products of 1 and the columns of ``of(x)``, over all rows of ``vectors``."""
    parts = vectors.select("x").mapInArrow(_products(of), "i int, task int, row array<double>")
    parts = parts.groupBy("i", "task").applyInArrow(_added, "i int, row array<double>")
    parts = parts.groupBy("i").applyInArrow(_added, "i int, row array<double>")
    rows = sorted(parts.collect())  # as many as a vector has entries, and one
    return np.array([r.row for r in rows])


@dataclass
class Whitening:
    """Fitted components: ``vectors`` has them as columns, by falling ``values`` (the variances along them)."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less their mean, without the rounding of a large mean."""
        whole, rest = np.array([divmod(s, self.n) for s in self.sums], np.int64).reshape(-1, 2).T
        return (x - whole) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, most: int = 32) -> Whitening:
    """The first ``most`` components of whole-number vectors (columns id, x), all rows of one length.

    Components without variance (beyond the rank of the covariance) are left out.
    Raises if vectors differ in length, or if their sums exceed a long.
    """
    sums = vectors.select("x").mapInArrow(_sums, "n long, sums array<long>")
    rows = sums.select("n", F.size("sums").alias("d"), F.posexplode("sums").alias("i", "s")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = sorted(rows.collect())
    if not found:
        return Whitening()
    if found[0].d != found[-1].d:
        raise ValueError("vectors differ in length")
    fitted = Whitening(found[0].n, [r.s for r in found])
    covariance = products(vectors, fitted.centred)[1:, 1:] / fitted.n
    values, components = eigenvectors(covariance)
    kept = min(most, int((values > len(values) * EPS * max(values[0], 0.0)).sum()))
    fitted.values, fitted.vectors, fitted.trace = values[:kept], components[:, :kept], float(np.trace(covariance))
    if kept:
        seen = products(vectors, fitted.whitened) / fitted.n
        covariance = seen[1:, 1:] - np.outer(seen[0, 1:], seen[0, 1:])
        fitted.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return fitted


def _rows(fitted: Whitening):
    kept = len(fitted.values)
    numbers, explained = np.arange(1, kept + 1, dtype=np.int32), fitted.values / (fitted.trace or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches):
            n = len(x)
            if n and kept and fitted.n * np.abs(x.astype(float)).max() >= LIMIT:
                raise OverflowError("entries are too large for exact deviations")
            apart = fitted.n * x - np.array(fitted.sums, np.int64)
            if n and kept and (apart.astype(float) ** 2).sum(1).max() >= 2 * LIMIT:
                raise OverflowError("deviations do not fit a long")
            deviation = (apart * apart).sum(1)
            at = pa.array(np.repeat(np.arange(n), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(at),
                    pa.array(np.tile(numbers, n)),
                    pa.array(np.repeat(deviation, kept)),
                    pa.array(fitted.whitened(x).ravel()),
                    pa.array(np.tile(explained, n)),
                ],
                ["id", "component", "deviation", "whitened", "explained"],
            )

    return run


def whiten(vectors: DataFrame, fitted: Whitening, id_col: str = "vec_id") -> DataFrame:
    """A row per vector and component: vec_id, component, deviation, whitened, explained.

    ``vectors`` has columns id and x (``whole_numbers``); components are numbered
    from 1. ``deviation`` is the sum over the entries of (n x - S)^2, exact;
    ``whitened`` the centred vector along the component, over the root of its
    variance; ``explained`` the share of that variance in all. Rows are kept as
    they are, repeated ones and null ids included. An empty table, and one whose
    vectors are all equal, gives no rows. A deviation beyond a long is an error.
    """
    schema = T.StructType(
        [
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
        ]
    )
    given = vectors.select("id", "x") if len(fitted.values) else vectors.select("id", "x").where(F.lit(False))
    return given.mapInArrow(_rows(fitted), schema).withColumnRenamed("id", id_col)
