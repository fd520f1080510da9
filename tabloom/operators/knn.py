"""Exact k nearest neighbours as a join that prunes.

Small reference sets (their size is checked) are broadcast and searched inside
an Arrow UDF, with no shuffle. Larger ones are joined in blocks: rows go down a
tree of pivots to the leaf that is nearest among those of the nearest branch.
Distances to the pivots bound how far a neighbour can be (triangle inequality):
for each leaf of queries whole branches of references are passed over, then
leaves, then rows. (Lu, Shen, Chen, Ooi: Efficient processing of k nearest
neighbor joins using MapReduce, VLDB 2012.)

Both sides are written once, sorted by leaf and packed into blocks of bounded
size. Tasks own blocks of queries, read the blocks of references that can matter
to them one after another from storage, and keep the ``k`` best of each query:
rows are never copied for the blocks they meet, so what is shuffled and written
follows the rows, not the pairs.

Of references with equal vectors only the ``k`` smallest ids can ever be among
the ``k`` nearest, so copies are reduced first, before any shuffle. Queries of
which most are copies are searched once for each vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.arrays import to_matrix
from tabloom.session import fits_within, write_table

BROADCAST_CELLS = 4_000_000  # numbers, about 32 MB
BROADCAST_ROWS = 20_000  # beyond this, pruning saves more than the shuffles cost
LEAST_LEAVES = 64
BLOCK_ROWS = 20_000
# leaves of references, the nearest first, that bound how far the neighbours of a leaf of queries are
BOUNDING = 32
CHUNK_CELLS = 4_000_000
# a packed block: rows, and bytes of its vectors
PACKED_ROWS, PACKED_BYTES = 4096, 1 << 20
DIGITS = 9
# copies of a query vector, on average, from which on each vector is searched once and joined back
FEWER = 2
NEIGHBOURS = "array<struct<distance:double,ref:bigint,value:double>>"


def nearest(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    broadcast_cells: int = BROADCAST_CELLS,
    leaves: int = LEAST_LEAVES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``neighbours`` to ``queries``: the ``k`` nearest references, nearest first.

    ``queries`` has ``vector array<double>`` (and any other columns);
    ``references`` has ``ref bigint, vector array<double>, value double``.
    Distances equal to nine digits are ordered by ``ref``. The tree of pivots has
    ``leaves`` leaves at least, and one for each ``block_rows`` references; rows are
    packed into blocks of bounded bytes whatever their leaves.
    """
    references = references.select("ref", "vector", F.col("value").cast("double"))
    width = references.select(F.size("vector")).first()
    if width is None:
        raise ValueError("There are no reference rows.")
    limit = min(BROADCAST_ROWS, broadcast_cells // max(1, width[0]))
    if fits_within(references, limit):
        return _broadcast_search(queries, references.toPandas(), k)
    found = queries.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("vector")).alias("different")).first()
    if found["different"] * FEWER > found["n"]:
        return _block_search(queries, references, k, leaves, block_rows)
    # equal vectors have the same neighbours: each is searched once
    once = _block_search(queries.select("vector").distinct(), references, k, leaves, block_rows)
    return queries.join(write_table(once, "neighbours"), "vector", "left").select(*queries.columns, "neighbours")


def top_k(q: np.ndarray, refs: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, reference positions and distances of the ``k`` nearest.

    A matrix product finds candidates; only those within rounding error of the
    k-th are measured exactly.
    """
    k = min(k, len(refs))
    r2 = np.einsum("ij,ij->i", refs, refs)
    step = max(1, CHUNK_CELLS // max(1, len(refs)))
    found = []
    for start in range(0, len(q), step):
        part = q[start : start + step]
        q2 = np.einsum("ij,ij->i", part, part)[:, None]
        rough = q2 + r2[None, :] - 2.0 * part @ refs.T
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
        slack = 1e-9 * (1.0 + q2 + r2.max())
        rows, cols = np.nonzero(rough <= kth + slack)
        gaps = np.empty(len(rows))
        block = max(1, CHUNK_CELLS // max(1, refs.shape[1]))
        for s in range(0, len(rows), block):
            d = part[rows[s : s + block]] - refs[cols[s : s + block]]
            gaps[s : s + block] = np.sqrt(np.einsum("ij,ij->i", d, d))
        gaps = np.round(gaps, DIGITS)
        order = np.lexsort((ids[cols], gaps, rows))
        rows, cols, gaps = rows[order], cols[order], gaps[order]
        first = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - first < k
        found.append((rows[keep] + start, cols[keep], gaps[keep]))
    if not found:
        empty = np.empty(0)
        return empty.astype(int), empty.astype(int), empty
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors.to_numpy()])


def _broadcast_search(queries: DataFrame, references: pd.DataFrame, k: int) -> DataFrame:
    context = queries.sparkSession.sparkContext
    shared = context.broadcast(
        (_matrix(references["vector"]), references["ref"].to_numpy(), references["value"].to_numpy(dtype=float))
    )

    @F.arrow_udf(NEIGHBOURS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        refs, ids, values = shared.value
        for vectors in batches:
            q = to_matrix(vectors)
            rows, at, gaps = top_k(q, refs, ids, k) if len(q) else (np.empty(0, int), np.empty(0, int), np.empty(0))
            found = pa.StructArray.from_arrays(
                [pa.array(gaps), pa.array(ids[at], pa.int64()), pa.array(values[at])], ["distance", "ref", "value"]
            )
            offsets = np.searchsorted(rows, np.arange(len(q) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), found)

    return queries.withColumn("neighbours", search(F.col("vector")))


@dataclass
class Tree:
    """Pivots in two levels: a leaf belongs to the nearest of the tops."""

    leaves: np.ndarray
    tops: np.ndarray
    members: list[np.ndarray]

    @classmethod
    def build(cls, pivots: np.ndarray) -> Tree:
        tops = pivots[: max(1, round(len(pivots) ** 0.5))]
        of = _distances(pivots, tops).argmin(axis=1)
        # leaves of a branch have numbers that follow each other, so that blocks sorted by leaf hold near rows
        order = np.argsort(of, kind="stable")
        pivots, of = pivots[order], of[order]
        return cls(pivots, tops, [np.flatnonzero(of == t) for t in range(len(tops))])

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distance to the pivot."""
        leaf, gaps = np.zeros(len(x), np.int32), np.zeros(len(x))
        of = _distances(x, self.tops).argmin(axis=1) if len(x) else np.zeros(0, int)
        for t in np.unique(of):
            rows = np.flatnonzero(of == t)
            leaf[rows] = self.members[t][_distances(x[rows], self.leaves[self.members[t]]).argmin(axis=1)]
        if len(x):
            gaps = np.sqrt(((x - self.leaves[leaf]) ** 2).sum(axis=1))
        return leaf, gaps


def _apart(point: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of one point to others, from their differences."""
    return np.sqrt(((points - point) ** 2).sum(axis=1))


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all rows to all points, good enough to choose the nearest."""
    rough = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2.0 * x @ points.T
    return np.sqrt(np.maximum(rough, 0.0))


def _block_search(queries: DataFrame, references: DataFrame, k: int, leaves: int, block_rows: int) -> DataFrame:
    same = Window.partitionBy("vector").orderBy("ref")
    refs = references.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy")
    wanted = max(leaves, -(-references.count() // block_rows))
    # a pivot for each block of references
    tree = Tree.build(_matrix(refs.orderBy(F.xxhash64("ref"), "ref").limit(wanted).toPandas()["vector"]))
    cells = _cell_udf(queries, tree)
    # the query id must not change between the two uses of the rows
    q = write_table(
        queries.withColumn("_qid", F.monotonically_increasing_id()).withColumn("_c", cells(F.col("vector"))), "queries"
    )
    r = write_table(refs.withColumn("_c", cells(F.col("vector"))), "references")
    bounds = _bounds(r, tree, k)
    right = write_table(_packed(r, "ref", "value").withColumn("rb", F.monotonically_increasing_id()), "reference-blocks")
    index = [np.array(c) for c in zip(*right.select("rb", "first", "last").collect())]  # three numbers a block
    wanted_by = _needs(q, bounds, index)
    left = write_table(wanted_by(_packed(q, "_qid")).withColumn("qb", F.monotonically_increasing_id()), "query-blocks")
    # neither side is shuffled: a task takes all pairs of its blocks of queries
    pairs = left.join(
        right.select("rb", *[F.col(c).alias(f"r_{c}") for c in _PACKED]).hint("shuffle_replicate_nl"),
        F.array_contains("needs", F.col("rb")),
    )
    shared = q.sparkSession.sparkContext.broadcast(bounds)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Nearest] = {}
        for batch in batches:
            names = batch.schema.names
            at = {n: batch.column(names.index(n)) for n in ("qb", *_PACKED, *[f"r_{c}" for c in _PACKED])}
            for i in range(batch.num_rows):
                block = at["qb"][i].as_py()
                if block not in held:
                    held[block] = _Nearest(k, shared.value, *_unpacked([at[c][i] for c in _PACKED])[:4])
                held[block].meet(*_unpacked([at[f"r_{c}"][i] for c in _PACKED]))
        for block in held.values():
            yield block.rows()

    partial = pairs.coalesce(max(1, left.rdd.getNumPartitions())).mapInArrow(search, "_qid bigint, distance double, ref bigint, value double")
    best = Window.partitionBy("_qid").orderBy("distance", "ref")
    merged = (
        partial.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k)
        .groupBy("_qid")
        .agg(F.sort_array(F.collect_list(F.struct("distance", "ref", "value"))).alias("neighbours"))
    )
    return q.drop("_c").join(merged, "_qid", "left").drop("_qid")


def _cell_udf(df: DataFrame, tree: Tree):
    shared = df.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("struct<cell:int,distance:double>")
    def cell(vectors: pa.Array) -> pa.Array:
        leaf, gaps = shared.value.find(to_matrix(vectors))
        return pa.StructArray.from_arrays([pa.array(leaf), pa.array(gaps)], ["cell", "distance"])

    return cell


@dataclass
class Bounds:
    """What is known of the references of each leaf: the ``k`` least distances to its pivot, and the largest."""

    tree: Tree
    near: dict[int, np.ndarray]
    far: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.held = np.array(sorted(self.near))
        tree = self.tree
        # how far the references of a branch are from its top
        self.spans = np.array([(_apart(tree.tops[t], tree.leaves[m]) + self.far[m]).max() if len(m) else -np.inf for t, m in enumerate(tree.members)])

    def around(self, cell: int, own: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries of a leaf, at most ``own`` from its pivot: the leaves of references that matter, and the distances to their pivots at which rows do."""
        tree, k = self.tree, self.k
        point = tree.leaves[cell]
        to_tops = _apart(point, tree.tops)
        # every query has k references within this distance: those nearest to the pivots of near leaves
        gaps, seen = [], 0
        for t in np.argsort(to_tops):
            mine = np.intersect1d(tree.members[t], self.held)
            apart = _apart(point, tree.leaves[mine])
            for i in np.argsort(apart):
                gaps.append(own + apart[i] + self.near[int(mine[i])])
                seen += 1
            if seen >= BOUNDING and sum(map(len, gaps)) >= k:
                break
        upper = np.sort(np.concatenate(gaps))
        theta = (upper[k - 1] if len(upper) >= k else np.inf) * (1.0 + 1e-9)
        leaves, low, high = [], [], []
        for t in np.flatnonzero(to_tops - self.spans - own <= theta + 1e-9):
            mine = np.intersect1d(tree.members[t], self.held)
            apart = _apart(point, tree.leaves[mine])
            matter = apart - self.far[mine] - own <= theta + 1e-9
            leaves.append(mine[matter])
            low.append(apart[matter] - own - theta - 1e-9)
            high.append(apart[matter] + own + theta + 1e-9)
        if not leaves:
            return np.empty(0, int), np.empty(0), np.empty(0)
        return np.concatenate(leaves), np.concatenate(low), np.concatenate(high)


def _bounds(r: DataFrame, tree: Tree, k: int) -> Bounds:
    closest = Window.partitionBy("_c.cell").orderBy("_c.distance")
    inner = r.withColumn("_rank", F.row_number().over(closest)).where(F.col("_rank") <= k)
    known = inner.groupBy(F.col("_c.cell").alias("cell")).agg(F.sort_array(F.collect_list("_c.distance")).alias("near"))
    widest = r.groupBy(F.col("_c.cell").alias("cell")).agg(F.max("_c.distance").alias("far"))
    near: dict[int, np.ndarray] = {}
    far = np.full(len(tree.leaves), -np.inf)  # of leaves without references
    for row in known.join(widest, "cell").collect():  # k numbers a leaf
        near[row.cell], far[row.cell] = np.array(row.near), row.far
    return Bounds(tree, near, far, k)


def _routes(q: DataFrame, r: DataFrame, tree: Tree, k: int) -> DataFrame:
    """For each leaf of queries the leaves of references that matter, and the distances to their pivots at which rows do."""
    shared = q.sparkSession.sparkContext.broadcast(_bounds(r, tree, k))
    reach = q.groupBy(F.col("_c.cell").alias("cell")).agg(F.max("_c.distance").alias("far"))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                leaves, low, high = shared.value.around(cell, own)
                columns = (pa.array(np.full(len(leaves), cell), pa.int32()), pa.array(leaves, pa.int32()), pa.array(low), pa.array(high))
                yield pa.RecordBatch.from_arrays(list(columns), ["query_cell", "ref_cell", "near", "far"])

    return reach.mapInArrow(routes, "query_cell int, ref_cell int, near double, far double")


# a block as bytes: ids, leaves, distances to their pivots, vectors, values
_PACKED = ("ids", "cells", "gaps", "vectors", "values")


def _packed(rows: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Rows sorted by leaf, in blocks: ``first`` and ``last`` leaf, and the columns ``_PACKED``."""
    count, width = rows.count(), len(rows.select("vector").first()["vector"]) if rows.take(1) else 1
    limit = max(1, min(PACKED_ROWS, PACKED_BYTES // (8 * max(1, width))))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-count // limit), max(4 * cores, -(-count // (16 * limit)))))
    chosen = rows.select(
        F.col(key).alias("id"), F.col("_c.cell").alias("cell"), F.col("_c.distance").alias("gap"), "vector",
        (F.col(value) if value else F.lit(None)).cast("double").alias("value"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def packed() -> pa.RecordBatch:
            block = pa.Table.from_batches(waiting).combine_chunks()
            cells = block["cell"].to_numpy().astype(np.int32)
            kept = (block["id"].to_numpy(), cells, block["gap"].to_numpy(), to_matrix(block["vector"].combine_chunks()), block["value"].to_numpy().astype(float))
            columns = [pa.array([int(cells[0])], pa.int32()), pa.array([int(cells[-1])], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([c.tobytes()], pa.binary()) for c in kept]], ["first", "last", *_PACKED])

        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, limit - n)
                batch = batch.slice(piece.num_rows)
                waiting.append(piece)
                n += piece.num_rows
                if n == limit:
                    yield packed()
                    waiting, n = [], 0
        if n:
            yield packed()

    # ranges of leaf and id: a leaf that holds a third of all rows becomes many blocks
    ordered = chosen.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell")
    return ordered.mapInArrow(pack, "first int, last int, " + ", ".join(f"{c} binary" for c in _PACKED))


def _unpacked(block: list) -> list[np.ndarray]:
    kinds = (np.int64, np.int32, float, float, float)
    found = [np.frombuffer(b.as_buffer(), t) for b, t in zip(block, kinds)]
    found[3] = found[3].reshape(len(found[0]), -1)
    return found


def _leaf_runs(cells: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]))


def _needs(q: DataFrame, bounds: Bounds, index: list[np.ndarray]):
    """Adds ``needs`` to blocks of queries: the blocks of references that can matter to them."""
    shared = q.sparkSession.sparkContext.broadcast((bounds, index))

    @F.arrow_udf("array<bigint>")
    def needs(cells: pa.Array, gaps: pa.Array) -> pa.Array:
        bounds, (numbers, first, last) = shared.value
        out = []
        for c, g in zip(cells, gaps):
            cell, gap = np.frombuffer(c.as_buffer(), np.int32), np.frombuffer(g.as_buffer(), float)
            matters = np.zeros(len(bounds.far) + 1, int)
            for a, b in _leaf_runs(cell):
                matters[1 + bounds.around(int(cell[a]), float(gap[a:b].max()))[0]] = 1
            before = np.cumsum(matters)
            out.append(numbers[before[last + 1] > before[first]].tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return lambda blocks: blocks.withColumn("needs", needs("cells", "gaps")).drop("first", "last")


class _Nearest:
    """The nearest references so far of a block of queries."""

    def __init__(self, k: int, bounds: Bounds, ids: np.ndarray, cells: np.ndarray, gaps: np.ndarray, x: np.ndarray):
        self.k, self.ids, self.x = k, ids, x
        self.squares = np.einsum("ij,ij->i", x, x)
        self.gaps = np.full((len(ids), k), np.inf)
        self.refs = np.full((len(ids), k), -1)
        self.values = np.zeros((len(ids), k))
        self.runs = []
        for a, b in _leaf_runs(cells):
            leaves, near, far = bounds.around(int(cells[a]), float(gaps[a:b].max()))
            low, high = np.full(len(bounds.far), np.inf), np.full(len(bounds.far), -np.inf)
            low[leaves], high[leaves] = near, far
            self.runs.append((np.arange(a, b), low, high))

    def meet(self, ids: np.ndarray, cells: np.ndarray, gaps: np.ndarray, y: np.ndarray, values: np.ndarray) -> None:
        """Measure the references that can matter."""
        whole = []
        for rows, low, high in self.runs:
            keep = (gaps >= low[cells]) & (gaps <= high[cells])
            if keep.all():
                whole.append(rows)
            elif keep.any():
                self._measure(rows, ids[keep], y[keep], values[keep])
        if whole:
            self._measure(np.concatenate(whole), ids, y, values)

    def _measure(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray, values: np.ndarray) -> None:
        squares = np.einsum("ij,ij->i", y, y)
        step = max(1, CHUNK_CELLS // len(y))
        for start in range(0, len(rows), step):
            own = rows[start : start + step]
            part, q2 = self.x[own], self.squares[own]
            rough = part @ (-2.0 * y.T)
            rough += q2[:, None]
            rough += squares[None, :]
            # as far as the k-th so far, or else the k-th of these; only those within rounding error of it are measured exactly
            limit = (self.gaps[own, -1] + 10.0**-DIGITS) ** 2
            open_ = np.flatnonzero(np.isinf(limit))
            if len(open_) and len(y) >= self.k:
                limit[open_] = np.partition(rough[open_], self.k - 1, axis=1)[:, self.k - 1]
            limit += 1e-9 * (1.0 + q2 + squares.max())
            at, cols = np.nonzero(rough <= limit[:, None])
            if not len(at):
                continue
            exact = np.empty(len(at))
            block = max(1, CHUNK_CELLS // max(1, y.shape[1]))
            for s in range(0, len(at), block):
                d = part[at[s : s + block]] - y[cols[s : s + block]]
                exact[s : s + block] = np.sqrt(np.einsum("ij,ij->i", d, d))
            self._keep(own[at], np.round(exact, DIGITS), ids[cols], values[cols])

    def _keep(self, rows: np.ndarray, gaps: np.ndarray, refs: np.ndarray, values: np.ndarray) -> None:
        """The ``k`` best of those so far and the new ones, ties by ``ref``."""
        mine = np.unique(rows)
        rows = np.concatenate([np.repeat(mine, self.k), rows])
        gaps = np.concatenate([self.gaps[mine].ravel(), gaps])
        refs = np.concatenate([self.refs[mine].ravel(), refs])
        values = np.concatenate([self.values[mine].ravel(), values])
        order = np.lexsort((refs, gaps, rows))
        rows = rows[order]
        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < self.k]
        for held, new in ((self.gaps, gaps), (self.refs, refs), (self.values, values)):
            held[mine] = new[order].reshape(len(mine), self.k)

    def rows(self) -> pa.RecordBatch:
        found = np.isfinite(self.gaps)
        columns = (np.repeat(self.ids, found.sum(axis=1)), self.gaps[found], self.refs[found], self.values[found])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_qid", "distance", "ref", "value"])


def majority(neighbours: Column) -> Column:
    """Most frequent value among the neighbours; a tie goes to the smallest."""
    values = F.transform(neighbours, lambda n: n["value"])
    votes = F.transform(
        F.array_distinct(values),
        lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("value")),
    )
    return F.array_min(votes)["value"]


def mean_value(neighbours: Column) -> Column:
    total = F.aggregate(neighbours, F.lit(0.0), lambda acc, n: acc + n["value"])
    return total / F.size(neighbours)


def vote_shares(neighbours: Column, classes: int) -> Column:
    """Share of the neighbours in each class ``0 .. classes-1``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda c: F.size(F.filter(neighbours, lambda n: n["value"] == c)) / F.size(neighbours),
    )


def vector_array(column: str) -> Column:
    return vector_to_array(F.col(column))
