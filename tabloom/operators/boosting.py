"""Gradient boosted trees over binned features: second order, level by level or best leaf first.

Features are cut once into at most 256 bins and packed, with the label, into
blocks of bytes. Each pass over the blocks sums gradients and second derivatives
by node, feature and bin, for one of two siblings only (the other is the parent
less that one); the driver picks splits from those sums, whose size follows the
features and the leaves, not the rows. Best-first trees ask for the sums of the
most promising leaves of a pass together and still split in strict order of gain.
All classes of a round, and all parts of a cross-validation, grow in the same
passes.

Rows of the same bins and label have the same gradients at all times, so they are
counted first (for squared error on all rows, those of the same bins, by the mean of
their labels); what is drawn of them is a binomial number. Where a million counted rows
are enough, they are one block. For squared error on drawn rows a cell of the same bins is
told, in each round, by how many of its rows are drawn and the sum of their labels: margins are
those of the cell, so one pass over the rows draws for all rounds. Other tables are packed row by row.

Blocks hold state (the margins so far) and are worked on by imperative code per
partition, hundreds of times over; so they are an RDD of arrays, persisted, with
its lineage cut by a checkpoint in the shared folder every few rounds. A table
that is one block (a million rows, 16 million cells at most) has nothing to exchange: its passes
follow each other in one task, and several such parts run side by side. The
result is stored in the public form of MLlib's boosted models and loaded as one,
so scoring, streams, the model store and attribution need nothing new.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.arrays import to_matrix
from tabloom.functions.quantiles import chunked_agg
from tabloom.operators.cells import binned, bins_of, by_label, by_mean, counted, numberable
from tabloom.operators.prep import FEATURES
from tabloom.session import checkpoint_folder, fresh_path, run_jobs, write_table

BINS = 256
# rows of a block, and cells of its features
BLOCK_ROWS, BLOCK_CELLS = 1_000_000, 16_000_000
# partial sums that are added up in one place
FAN = 32
# leaves whose sums one pass of a best-first tree asks for
AHEAD = 8
# bins that the features of a bundle have together at most
BUNDLE_BINS = 4096
ROUNDS_PER_CHECKPOINT = 20
# cells times rounds whose drawn sums one task reads; rows that a task draws, and that it draws together
MOST_DRAWN, DRAWN_ROWS, DRAWN_AT_ONCE = 32_000_000, 500_000, 65_536
# rows of a block up to which the sums of all nodes of a level are made together, and sums that are held of them
LEVEL_ROWS, LEVEL_SUMS = 200_000, 4_000_000
# bins that the features of a bundle have together at most where nodes are many
LEVEL_BINS = 128
DEEPEST = 30
ROW_ID = "_rid"
SKETCH_ACCURACY = 10_000
# gains that differ by less, for their size, are the same but for rounding: the first cut is taken
EVEN = 1e-10

SQUARED, LOGISTIC, SOFTMAX = "squared", "logistic", "softmax"


@dataclass(frozen=True)
class Settings:
    """How trees grow. ``leaves`` = 0 splits all leaves of a level, else the best leaf first."""

    rounds: int = 200
    rate: float = 0.05
    depth: int = 6
    leaves: int = 0
    penalty: float = 1.0
    least_weight: float = 1.0
    least_rows: int = 1
    rows_share: float = 1.0
    columns_share: float = 1.0
    seed: int = 42


@dataclass
class GrownTree:
    """Nodes of a tree, the root first; ``left`` is -1 for a leaf. A row goes left if its bin is ``bin`` at most."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, value: float, rows: float) -> int:
        for column, empty in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.gain, -1.0)):
            column.append(empty)
        self.value.append(value)
        self.rows.append(rows)
        return len(self.value) - 1


# bins


def thresholds(df: DataFrame, width: int, most: int = BINS) -> list[np.ndarray]:
    """Cut points per feature: between all values of a feature of up to ``most``, at quantiles of others."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [np.empty(0)] * width
        for batch in batches:
            x = to_matrix(batch.column(0))
            for i in range(width if len(x) else 0):
                if held[i] is not None:
                    found = np.union1d(held[i], x[:, i])
                    held[i] = found if len(found) <= most else None
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([h is None for h in held]), pa.array([[] if h is None else h.tolist() for h in held], pa.list_(pa.float64()))],
            ["position", "many", "seen"],
        )

    arrays = df.select(vector_to_array(F.col(FEATURES)).alias("x"))
    found = arrays.mapInArrow(values, "position int, many boolean, seen array<double>").groupBy("position")
    few = F.when(~F.bool_or("many"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))))
    rows = {r.position: r.seen for r in found.agg(few.alias("seen")).collect()}
    cuts: list = [None] * width
    wide = []
    for i in range(width):
        seen = rows.get(i)
        if seen is None or len(seen) > most:
            wide.append(i)
        else:
            seen = np.array(seen)
            cuts[i] = (seen[1:] + seen[:-1]) / 2
    if wide:
        shares = F.array(*[F.lit(j / most) for j in range(1, most)])
        quantiles = chunked_agg(arrays, {i: F.percentile_approx(F.get("x", F.lit(i)), shares, SKETCH_ACCURACY) for i in wide}, 50)
        for i in wide:
            cuts[i] = np.unique(np.array(quantiles[i], float))
    return cuts


# blocks: part, row keys, bins (features x rows), label, margins (outputs x rows)
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def block_limit(cuts: list[np.ndarray]) -> int:
    """Rows of a block at most."""
    return max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, len(cuts))))


def blocks_of(df: DataFrame, label: str, cuts: list[np.ndarray], part: int, start: np.ndarray) -> tuple[RDD, int]:
    """The rows of one part, binned and packed, and the number of blocks; ``start`` has the first margin of each output.

    A row is told by ``_rid`` if there is one, so that what a round draws does
    not depend on how rows lie in blocks, or else by its place in the table.
    """
    width = len(cuts)
    limit = block_limit(cuts)

    def packed(x: list[np.ndarray], y: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        matrix = np.concatenate(x)
        bins = np.stack([np.searchsorted(cuts[i], matrix[:, i], "left").astype(np.uint8) for i in range(width)])
        columns = (bins, np.concatenate(y), np.concatenate(keys))
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["bins", "label", "keys"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, keys, held = [], [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, limit):
                piece = batch.slice(first, limit)
                if held + piece.num_rows > limit:
                    yield packed(x, y, keys)
                    x, y, keys, held = [], [], [], 0
                x.append(to_matrix(piece.column("x")))
                y.append(np.asarray(piece.column("y"), float))
                keys.append(np.asarray(piece.column("key"), np.int64))
                held += piece.num_rows
        if held:
            yield packed(x, y, keys)

    rows = df.select(vector_to_array(F.col(FEATURES)).alias("x"), F.col(label).cast("double").alias("y"), row_key(df).alias("key"))
    total = rows.count()
    if total <= limit:
        rows = rows.coalesce(1)
    stored = write_table(rows.mapInArrow(pack, "bins binary, label binary, keys binary"), "blocks")
    numbered = stored.rdd.zipWithIndex()
    count = stored.count()
    tasks = max(1, min(count, max(256, count // 16)))

    def unpacked(item) -> Block:
        bins, labels, keys = (bytes(c) for c in item[1])
        y = np.frombuffer(labels, float)
        return part, np.frombuffer(keys, np.uint64), np.frombuffer(bins, np.uint8).reshape(width, len(y)), y, np.repeat(start[:, None], len(y), axis=1)

    return numbered.map(lambda r: (r[1], tuple(r[0]))).partitionBy(tasks, lambda number: number).map(unpacked), count


def counted_block(df: DataFrame, label: str, cuts: list[np.ndarray], part: int, start: np.ndarray, loss: str, share: float) -> RDD | None:
    """A block of counted rows and their counts, or ``None`` where they are too many for one, or where draws tell the rows of a cell apart by their labels."""
    if not numberable(cuts) or (loss == SQUARED and share < 1):
        return None
    pieces = counted(df, label, cuts)
    cells = write_table(by_mean(pieces) if loss == SQUARED else by_label(pieces), "cells")
    if cells.count() > block_limit(cuts):
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if filled:
            held = pa.Table.from_batches(filled)
            yield pa.RecordBatch.from_arrays([pa.array([held[c].to_numpy().tobytes()], pa.binary()) for c in ("cell", "y", "n")], ["cell", "y", "n"])

    def unpacked(row) -> tuple[Block, np.ndarray]:
        cell, n = (np.frombuffer(bytes(c), np.int64) for c in (row[0], row[2]))
        y = np.frombuffer(bytes(row[1]), float)
        return (part, cell.view(np.uint64), bins_of(cell, cuts), y, np.repeat(start[:, None], len(y), axis=1)), n

    return cells.coalesce(1).sortWithinPartitions("cell", "y").mapInArrow(pack, "cell binary, y binary, n binary").rdd.map(unpacked)


def row_key(df: DataFrame) -> Column:
    """What tells a row: ``_rid`` if there is one, so that what a round draws does not depend on how rows lie, or else its place."""
    return F.col(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id()


def drawn_cells(df: DataFrame, label: str, cuts: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, DataFrame] | None:
    """The cells of some rows, in rising order, and ``turn, first, n, total``: of the cells from ``first`` on, how many rows a round draws and the sum of their labels.

    Rows are drawn one by one, by their keys. They are dealt by cell and key, so that a large cell is shared by
    several tasks and the sums follow the cells. ``None`` where there are too many cells, or hardly fewer than rows.
    """
    if not numberable(cuts):
        return None
    rows = binned(df, label, cuts, row_key(df))
    cells = write_table(rows.groupBy("cell").agg(F.count("*").alias("n")), "cells")
    count, total = cells.agg(F.count("*"), F.sum("n")).first()
    if not count or count > block_limit(cuts) or count * settings.rounds > MOST_DRAWN or 4 * count > total:
        return None
    known = np.sort(cells.select("cell").toArrow()["cell"].to_numpy())
    shared = df.sparkSession.sparkContext.broadcast(known)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        held = pa.Table.from_batches(filled)
        cell, y, keys = (held[c].to_numpy() for c in ("cell", "y", "key"))
        place = np.searchsorted(shared.value, cell)
        first = int(place[0])
        mixed, pieces = _mixed(keys.astype(np.int64).view(np.uint64)), []
        for a in range(0, len(y), DRAWN_AT_ONCE):
            own = place[a : a + DRAWN_AT_ONCE] - first
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            pieces.append((mixed[a : a + DRAWN_AT_ONCE], y[a : a + DRAWN_AT_ONCE], begins, own[begins]))
        for turn in range(settings.rounds):
            n, total = np.zeros(place[-1] - first + 1, np.int64), np.zeros(place[-1] - first + 1)
            for keys_of, y_of, begins, at in pieces:
                used = drawn_mixed(settings.rows_share, settings.seed, turn, keys_of)
                n[at] += np.add.reduceat(used, begins, dtype=np.int64)
                total[at] += np.add.reduceat(y_of * used, begins)
            columns = [pa.array([turn], pa.int32()), pa.array([first], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["turn", "first", "n", "total"])

    stored = write_table(rows, "binned-rows")
    dealt = stored.repartitionByRange(max(1, -(-total // DRAWN_ROWS)), "cell", "key").sortWithinPartitions("cell", "key")
    return known, write_table(dealt.mapInArrow(draw, "turn int, first int, n binary, total binary"), "drawn")


def drawn_turns(rows: Iterator, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows drawn and sum of their labels of all cells, round after round."""
    for _, pieces in itertools.groupby(rows, lambda r: r[0]):
        n, total = np.zeros(cells), np.zeros(cells)
        for _, first, own, sums in pieces:
            own = np.frombuffer(bytes(own), np.int64)
            n[first : first + len(own)] += own
            total[first : first + len(own)] += np.frombuffer(bytes(sums), float)
        yield n, total


def gradients(loss: str, margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the margin: outputs x rows."""
    if loss == SQUARED:
        return margins - label, np.ones_like(margins)
    if loss == LOGISTIC:
        p = 1.0 / (1.0 + np.exp(-margins))
        return p - label, np.maximum(p * (1 - p), 1e-16)
    p = np.exp(margins - margins.max(axis=0))
    p /= p.sum(axis=0)
    return p - (label == np.arange(len(margins))[:, None]), np.maximum(p * (1 - p), 1e-16)


def reached(tree: GrownTree, bins: np.ndarray) -> np.ndarray:
    """The node of each row in which it ends."""
    feature, cut, left, right = (np.array(c) for c in (tree.feature, tree.bin, tree.left, tree.right))
    node, going = np.zeros(bins.shape[1], np.int32), np.arange(bins.shape[1])
    while True:
        going = going[left[node[going]] >= 0]
        if not len(going):
            return node
        at = node[going]
        node[going] = np.where(bins[feature[at], going] <= cut[at], left[at], right[at])


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def drawn_rows(share: float, seed: int, turn: int, keys: np.ndarray) -> np.ndarray | None:
    """Which rows a round uses; ``None`` for all."""
    return None if share >= 1 else drawn_mixed(share, seed, turn, _mixed(keys))


def drawn_mixed(share: float, seed: int, turn: int, mixed: np.ndarray) -> np.ndarray:
    own = _mixed(np.array([seed * 1_000_003 + turn], np.uint64))
    return _mixed(mixed ^ own) < np.uint64(int(share * 2.0**64))


def drawn_counts(share: float, seed: int, turn: int, counts: np.ndarray) -> np.ndarray:
    """How many of the rows that each counted row stands for a round uses."""
    if share >= 1:
        return counts.astype(float)
    return np.random.default_rng([seed, turn]).binomial(counts, share).astype(float)


def drawn_columns(share: float, seed: int, turn: int, output: int, width: int) -> np.ndarray:
    """The features that a tree may use."""
    if share >= 1:
        return np.arange(width)
    random = np.random.default_rng([seed, turn, output])
    return np.sort(random.choice(width, max(1, int(share * width + 1e-9)), replace=False))


# a wish for sums: tree so far, for each of its nodes the place of its sums (-1: not wanted), the features, and where the bins of each begin
Wish = tuple[GrownTree, np.ndarray, np.ndarray, np.ndarray]


# features whose bins are counted together: which, how many bins each has, and the key of each row
Bundle = tuple[list[int], list[int], np.ndarray]


def bundles_of(bins: np.ndarray, begins: np.ndarray, most: int = BUNDLE_BINS) -> list[Bundle]:
    """Features of few bins side by side in one key of ``most`` values, as one count of it tells those of each."""
    sizes = np.diff(begins)
    groups: list[list[int]] = []
    room: list[int] = []
    for f in np.argsort(-sizes, kind="stable"):
        size = max(1, int(sizes[f]))
        at = next((i for i, r in enumerate(room) if size <= r), None)
        if at is None:
            groups.append([])
            room.append(max(most, size))
            at = len(groups) - 1
        groups[at].append(int(f))
        room[at] //= size
    found = []
    for group in groups:
        key = bins[group[0]].astype(np.uint16)
        for f in group[1:]:
            key = key * np.uint16(max(1, sizes[f])) + bins[f]
        found.append((group, [max(1, int(sizes[f])) for f in group], key))
    return found


def row_sums(
    rows: np.ndarray, bundles: list[Bundle], columns: np.ndarray, begins: np.ndarray, g: np.ndarray, h: np.ndarray | None, n: np.ndarray | None = None
) -> np.ndarray:
    """(Gradient, second derivative, rows) x bins of all features, over some rows; ``h`` is ``None`` where it is 1, ``n`` where rows are not counted."""
    total = np.zeros((3, int(begins[-1])))
    own, second, many = g[rows], None if h is None else h[rows], None if n is None else n[rows]
    used = set(columns.tolist())
    for features, sizes, joint in bundles:
        wanted = [(axis, f) for axis, f in enumerate(features) if f in used and begins[f + 1] > begins[f]]
        if not wanted:
            continue
        key, size = joint[rows].astype(np.intp), math.prod(sizes)
        counts = [np.bincount(key, own, size), None if second is None else np.bincount(key, second, size), np.bincount(key, many, size)]
        for axis, f in wanted:
            others = tuple(i for i in range(len(features)) if i != axis)
            for i, count in enumerate(counts):
                if count is not None:
                    total[i, begins[f] : begins[f + 1]] = count.reshape(sizes).sum(axis=others)
    if second is None:
        total[1] = total[2]
    return total


def _summed(blocks: Iterator[Block], loss: str, wishes: Mapping[tuple[int, int], Wish], settings: Settings, turn: int) -> dict:
    """The sums of the wishes over some blocks, by (part, output)."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for part, keys, bins, label, margins in blocks:
        wanted = [o for o in range(len(margins)) if (part, o) in wishes]
        if not wanted:
            continue
        g, h = gradients(loss, margins, label)
        used = drawn_rows(settings.rows_share, settings.seed, turn, keys)
        bundles = bundles_of(bins, wishes[part, wanted[0]][3])
        for output in wanted:
            tree, places, columns, begins = wishes[part, output]
            place = places[reached(tree, bins)]
            if used is not None:
                place = np.where(used, place, -1)
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(int(places.max()) + 2))
            second = None if loss == SQUARED else h[output]
            total = np.stack([row_sums(order[a:b], bundles, columns, begins, g[output], second) for a, b in zip(ends, ends[1:])])
            found[part, output] = found[part, output] + total if (part, output) in found else total
    return found


def grow_levels(bins: np.ndarray, columns: np.ndarray, bundles: list[Bundle], weights: np.ndarray, settings: Settings) -> tuple[GrownTree, np.ndarray]:
    """One tree that splits all leaves of a level, and the node of each row; ``weights`` has its gradient, second derivative and number.

    Splits are those of ``Growing``; the sums of all nodes of a level are made together, a bundle at a time.
    """
    deepest = min(settings.depth or DEEPEST, DEEPEST)
    levels, ends, first = [], np.zeros(bins.shape[1], np.int64), 0
    rows, node = np.arange(bins.shape[1]), np.zeros(bins.shape[1], np.int64)  # by node, as a place in its level
    totals = weights.sum(axis=1, keepdims=True)

    def score(sums: np.ndarray) -> np.ndarray:
        return np.square(sums[0]) / np.maximum(sums[1] + settings.penalty, 1e-300)

    for depth in range(deepest + 1):
        count = totals.shape[1]
        gain, feature, cut = np.full(count, -np.inf), np.full(count, -1), np.full(count, -1)
        below, own = np.zeros((3, count)), score(totals)
        if depth < deepest and len(rows):
            place = np.searchsorted(node, np.arange(count + 1))
            used = set(columns.tolist())
            for features, sizes, joint in bundles:
                wanted = sorted((f, axis + 2) for axis, f in enumerate(features) if f in used and sizes[axis] > 1)
                size = math.prod(sizes)
                step = max(1, LEVEL_SUMS // (3 * size))
                for a in range(0, count if wanted else 0, step):
                    b = min(count, a + step)
                    some = rows[place[a] : place[b]]
                    key = (node[place[a] : place[b]] - a) * size + joint.take(some)
                    sums = np.stack([np.bincount(key, w.take(some), (b - a) * size) for w in weights]).reshape(3, b - a, *sizes)
                    for f, axis in wanted:
                        others = tuple(i for i in range(2, sums.ndim) if i != axis)
                        left = sums.sum(axis=others).cumsum(axis=2)[:, :, :-1]
                        right = totals[:, a:b, None] - left
                        fits = (np.minimum(left[2], right[2]) >= settings.least_rows - 0.5) & (np.minimum(left[1], right[1]) >= settings.least_weight)
                        gains = np.where(fits, score(left) + score(right) - own[a:b, None], -np.inf)
                        found = gains.max(axis=1)
                        even = EVEN * (own[a:b] + np.maximum(found, 0.0))
                        best = (gains >= (found - even)[:, None]).argmax(axis=1)
                        # bundles come in any order: of even gains that of the first feature counts
                        ahead = np.where(f < feature[a:b], -even, even)
                        better = np.flatnonzero(found > gain[a:b] + ahead)
                        gain[a + better], feature[a + better], cut[a + better] = gains[better, best[better]], f, best[better]
                        below[:, a + better] = left[:, better, best[better]]
        splits = gain > 1e-9 + 1e-12 * own
        levels.append((first, totals, splits, feature, cut, gain))
        ended = ~splits[node]
        ends[rows[ended]] = first + node[ended]
        if not splits.any():
            break
        going, at = rows[~ended], node[~ended]
        goes_right = bins[feature[at], going] > cut[at]
        number = np.cumsum(splits) - 1
        at = 2 * number[at] + goes_right
        order = np.argsort(at.astype(np.uint16) if 2 * number[-1] + 2 <= 2**16 else at, kind="stable")
        rows, node = going[order], at[order]
        first += count
        totals = np.stack([below[:, splits], totals[:, splits] - below[:, splits]], axis=2).reshape(3, -1)
    return _by_depth(levels, settings, ends)


def _by_depth(levels: list[tuple], settings: Settings, ends: np.ndarray) -> tuple[GrownTree, np.ndarray]:
    """The tree of some levels, each node before those below its left and then its right side, and the nodes ``ends`` by these numbers."""
    first, totals, splits, feature, cut, gain = (np.concatenate([np.broadcast_to(level[i], (*np.shape(level[i])[:-1], len(level[2]))) for level in levels], axis=-1) for i in range(6))
    weight = totals[1] + settings.penalty
    value = np.where(weight > 0, -totals[0] / np.where(weight > 0, weight, 1.0), 0.0)
    inner, count = np.flatnonzero(splits), len(splits)
    left = np.full(count, -1)
    left[inner] = 1 + 2 * np.arange(len(inner))  # children follow each other, level by level
    below = np.ones(count, np.int64)  # nodes at and below each
    number = np.zeros(count, np.int64)
    steps = np.cumsum([0, *[len(level[2]) for level in levels]])
    for a, b in reversed(list(zip(steps, steps[1:]))):
        at = a + np.flatnonzero(splits[a:b])
        below[at] += below[left[at]] + below[left[at] + 1]
    for a, b in zip(steps, steps[1:]):
        at = a + np.flatnonzero(splits[a:b])
        number[left[at]] = number[at] + 1
        number[left[at] + 1] = number[at] + 1 + below[left[at]]
    order = np.argsort(number)

    def renumbered(child: int) -> list[int]:
        return np.where(splits, number[np.where(splits, left + child, 0)], -1)[order].tolist()

    tree = GrownTree(
        np.where(splits, feature, -1)[order].tolist(), np.where(splits, cut, -1)[order].tolist(), renumbered(0), renumbered(1),
        value[order].tolist(), np.where(splits, gain, -1.0)[order].tolist(), totals[2][order].tolist(),
    )
    return tree, number[ends]


def _alone(
    block: Block,
    loss: str,
    settings: Settings,
    begins: np.ndarray,
    counts: np.ndarray | None = None,
    draws: Iterator[tuple[np.ndarray, np.ndarray]] | None = None,
) -> list[list[GrownTree]]:
    """All rounds over a table that is one block; ``counts`` tells how many rows each of its rows stands for, ``draws`` what each round takes of each and the sum of the labels."""
    _, keys, bins, label, margins = block
    margins, rounds = margins.copy(), []
    together = not settings.leaves and bins.shape[1] <= LEVEL_ROWS
    bundles = bundles_of(bins, begins, LEVEL_BINS if together else BUNDLE_BINS)
    for turn in range(settings.rounds):
        if draws is not None:
            n, total = next(draws)
            g, h, used = n * margins - total, np.broadcast_to(n, margins.shape), n > 0
        else:
            g, h = gradients(loss, margins, label)
            if counts is None:
                n, used = None, drawn_rows(settings.rows_share, settings.seed, turn, keys)
            else:
                n = drawn_counts(settings.rows_share, settings.seed, turn, counts)
                g, h, used = g * n, h * n, n > 0
        grown, steps = [], []
        for output in range(len(margins)):
            columns = drawn_columns(settings.columns_share, settings.seed, turn, output, len(bins))
            if together:
                many = n if n is not None else np.ones(len(label)) if used is None else used.astype(float)
                weights = np.stack([g[output], h[output], many])
                tree, ends = grow_levels(bins, columns, bundles, weights if n is not None else weights * many, settings)
                grown.append(tree)
                steps.append(np.array(tree.value)[ends])
                continue
            second = None if loss == SQUARED else h[output]
            growing = Growing(settings, columns, begins)
            rows = {0: np.arange(len(label)) if used is None else np.flatnonzero(used)}
            while (wish := growing.wish()) is not None:
                tree, sums = wish[0], []
                for node, _ in growing.asked:
                    if node not in rows:
                        above = growing.parent[node]
                        own = rows.pop(above)
                        goes_left = bins[tree.feature[above]][own] <= tree.bin[above]
                        rows[tree.left[above]], rows[tree.right[above]] = own[goes_left], own[~goes_left]
                    sums.append(row_sums(rows[node], bundles, columns, begins, g[output], second, n))
                growing.take(np.stack(sums))
            grown.append(growing.finished())
            steps.append(np.array(grown[-1].value)[reached(grown[-1], bins)])
        rounds.append(grown)
        margins += settings.rate * np.stack(steps)
    return rounds


def _together(parts: list[dict]) -> dict:
    out: dict = {}
    for part in parts:
        for key, sums in part.items():
            out[key] = out[key] + sums if key in out else sums
    return out


def sums_over(state: RDD, loss: str, wishes: Mapping, settings: Settings, turn: int) -> dict:
    """Sums over all blocks, added in the order of the partitions, ``FAN`` at a time."""
    found = state.mapPartitionsWithIndex(lambda i, b: [(i, _summed(b, loss, wishes, settings, turn))])
    tasks = state.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        grouped = found.map(lambda r: (r[0] // FAN, r)).groupByKey(tasks)
        found = grouped.map(lambda g: (g[0], _together([s for _, s in sorted(g[1], key=lambda r: r[0])])))
    return _together([s for _, s in sorted(found.collect(), key=lambda r: r[0])])


# growing


class Growing:
    """One tree while it grows: what is known of its leaves, and which sums it needs next."""

    def __init__(self, settings: Settings, columns: np.ndarray, begins: np.ndarray):
        self.settings, self.columns, self.begins = settings, columns, begins
        # of all bins: whether a cut after it can split (not after the last one of a feature), and its feature
        self.feature_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        cut = np.isin(self.feature_of, columns)
        cut[begins[1:] - 1] = False
        self.cuts = np.flatnonzero(cut)
        self.deepest = min(settings.depth or DEEPEST, DEEPEST)
        self.tree = GrownTree()
        self.tree.add(0.0, 0.0)
        self.leaves = 1
        self.depth = {0: 0}
        self.parent: dict[int, int] = {}
        self.sums: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple] = {}  # gain, feature, bin, and totals of both sides, of nodes that can be split
        self.asked: list[tuple[int, int | None]] = [(0, None)]  # node, and its sibling that follows from it
        self.queue: list[tuple[float, int]] = []
        self.ahead: dict[int, tuple[int, int]] = {}  # leaf -> children that are known, but not part of the tree yet
        self.waiting: dict[int, tuple[float, int]] = {}  # entries of the queue for such children

    def wish(self) -> Wish | None:
        """The tree as rows have to walk it, and where the sums of its nodes go."""
        if not self.asked:
            return None
        places = np.full(len(self.tree.value), -1)
        for place, (node, _) in enumerate(self.asked):
            places[node] = place
        walk = self.tree
        if self.ahead:
            walk = GrownTree(*[list(c) for c in (walk.feature, walk.bin, walk.left, walk.right, walk.value, walk.gain, walk.rows)])
            for leaf, (left, right) in self.ahead.items():
                _, walk.feature[leaf], walk.bin[leaf], _, _ = self.best[leaf]
                walk.left[leaf], walk.right[leaf] = left, right
        return walk, places, self.columns, self.begins

    def take(self, sums: np.ndarray | None) -> None:
        """Learn the sums that were asked for, split, and ask again."""
        for place, (node, sibling) in enumerate(self.asked):
            own = sums[place] if sums is not None else np.zeros((3, int(self.begins[-1])))
            self.learn(node, own)
            if sibling is not None:
                self.learn(sibling, self.sums.pop(self.parent[node]) - own)
        self.asked = []
        if self.settings.leaves:
            self.split_best()
        else:
            self.split_level()

    def value(self, g: float, h: float) -> float:
        weight = h + self.settings.penalty
        return float(-g / weight) if weight > 0 else 0.0

    def score(self, g, h):
        return np.square(g) / np.maximum(h + self.settings.penalty, 1e-300)

    def learn(self, node: int, sums: np.ndarray) -> None:
        """The best split of a node from its sums."""
        first = self.columns[0]
        g, h, n = (float(v) for v in sums[:, self.begins[first] : self.begins[first + 1]].sum(axis=1))
        if node == 0:
            self.tree.value[0], self.tree.rows[0] = self.value(g, h), n
        if self.depth[node] >= self.deepest or not len(self.cuts):
            return
        running = np.cumsum(sums, axis=1)
        before = np.concatenate([np.zeros((3, 1)), running], axis=1)[:, self.begins[:-1]]
        below = (running - before[:, self.feature_of])[:, self.cuts]
        above = np.array([[g], [h], [n]]) - below
        rows, weight = self.settings.least_rows, self.settings.least_weight
        fits = (below[2] >= rows - 0.5) & (above[2] >= rows - 0.5) & (below[1] >= weight) & (above[1] >= weight)
        own = float(self.score(g, h))
        gains = np.where(fits, self.score(below[0], below[1]) + self.score(above[0], above[1]) - own, -np.inf)
        gain = float(gains.max())
        best = int(np.argmax(gains >= gain - EVEN * (own + gain)))  # -inf: any
        if not gain > 1e-9 + 1e-12 * own:
            return
        self.sums[node] = sums
        at = int(self.cuts[best])
        feature = int(self.feature_of[at])
        self.best[node] = (gain, feature, at - int(self.begins[feature]), below[:, best], above[:, best])
        if self.parent.get(node) in self.ahead:
            self.waiting[node] = (-gain, node)
        else:
            heapq.heappush(self.queue, (-gain, node))

    def children(self, leaf: int) -> tuple[int, int]:
        """Nodes for both sides of the best split of a leaf, not joined to it yet."""
        made = []
        for g, h, n in self.best[leaf][3:]:
            node = self.tree.add(self.value(g, h), float(n))
            self.depth[node], self.parent[node] = self.depth[leaf] + 1, leaf
            made.append(node)
        return made[0], made[1]

    def join(self, leaf: int, pair: tuple[int, int]) -> None:
        gain, feature, cut, _, _ = self.best.pop(leaf)
        tree = self.tree
        tree.left[leaf], tree.right[leaf] = pair
        tree.feature[leaf], tree.bin[leaf], tree.gain[leaf] = feature, cut, gain
        self.leaves += 1

    def ask(self, pair: tuple[int, int]) -> None:
        """Ask for the sums of the smaller of two siblings; the other's follow."""
        left, right = pair
        self.asked.append((left, right) if self.tree.rows[left] <= self.tree.rows[right] else (right, left))

    def split_level(self) -> None:
        for _, leaf in sorted(self.queue, key=lambda q: q[1]):
            pair = self.children(leaf)
            self.join(leaf, pair)
            if self.depth[leaf] + 1 < self.deepest:
                self.ask(pair)
            else:
                del self.sums[leaf]
        self.queue = []

    def split_best(self) -> None:
        """Split leaves in order of gain as far as their children are known; then ask for those of the next best."""
        while self.queue and self.leaves < self.settings.leaves:
            leaf = self.queue[0][1]
            last = self.leaves + 1 == self.settings.leaves or self.depth[leaf] + 1 >= self.deepest
            if leaf in self.ahead or last:
                heapq.heappop(self.queue)
                self.join(leaf, self.ahead.pop(leaf, None) or self.children(leaf))
                for node in (self.tree.left[leaf], self.tree.right[leaf]):
                    if node in self.waiting:
                        heapq.heappush(self.queue, self.waiting.pop(node))
                continue
            for _, other in heapq.nsmallest(min(AHEAD, self.settings.leaves - self.leaves), self.queue):
                if other not in self.ahead and self.depth[other] + 1 < self.deepest:
                    self.ahead[other] = self.children(other)
                    self.ask(self.ahead[other])
            return

    def finished(self) -> GrownTree:
        """The tree without nodes that were only looked at, each before its children."""
        out, waiting = GrownTree(), [(0, -1, True)]
        tree = self.tree
        while waiting:
            node, above, is_left = waiting.pop()
            made = out.add(tree.value[node], tree.rows[node])
            out.gain[made] = tree.gain[node]
            if above >= 0:
                (out.left if is_left else out.right)[above] = made
            if tree.left[node] >= 0:
                out.feature[made], out.bin[made] = tree.feature[node], tree.bin[node]
                waiting += [(tree.right[node], made, False), (tree.left[node], made, True)]
        return out


def _grow(state: RDD, loss: str, trees: dict[tuple[int, int], Growing], settings: Settings, turn: int) -> None:
    """Grow the trees of all parts and outputs of a round in common passes."""
    while True:
        wishes = {key: wish for key, growing in trees.items() if (wish := growing.wish()) is not None}
        if not wishes:
            return
        found = sums_over(state, loss, wishes, settings, turn)
        for key in wishes:
            trees[key].take(found.get(key))


def first_margins(loss: str, df: DataFrame, label: str, classes: int) -> np.ndarray:
    """Margins before the first tree: the mean, or the log-odds of the classes."""
    if loss == SQUARED:
        return np.array([df.agg(F.avg(label)).first()[0] or 0.0])
    counts = {int(r[0]): r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}  # a row per class of the model
    total = sum(counts.values())
    shares = np.array([min(max(counts.get(c, 0) / total, 1e-6), 1 - 1e-6) for c in range(max(2, classes))])
    return np.array([math.log(shares[1] / (1 - shares[1]))]) if loss == LOGISTIC else np.log(shares)


def boost(
    tables: Mapping[int, DataFrame], label: str, classes: int, settings: Settings
) -> dict[int, tuple[np.ndarray, list[list[GrownTree]], list[np.ndarray]]]:
    """Fit one ensemble per table, all in the same passes.

    ``classes`` is 0 for a number as label. Returns for each table its first
    margins, the trees of each round by output, and the cut points of its features.
    """
    loss = SQUARED if not classes else LOGISTIC if classes <= 2 else SOFTMAX
    spark = next(iter(tables.values())).sparkSession
    checkpoint_folder(spark)
    starts, cuts, pieces, cells, drawn = {}, {}, {}, {}, {}
    for part, df in tables.items():
        width = df.select(F.size(vector_to_array(F.col(FEATURES)))).first()[0]
        cuts[part] = thresholds(df, width)
        starts[part] = first_margins(loss, df, label, classes)
        cells[part] = counted_block(df, label, cuts[part], part, starts[part], loss, settings.rows_share)
        drawn[part] = drawn_cells(df, label, cuts[part], settings) if loss == SQUARED and settings.rows_share < 1 else None
        if cells[part] is None and drawn[part] is None:
            pieces[part] = blocks_of(df, label, cuts[part], part, starts[part])
    begins = {part: begins_of(own) for part, own in cuts.items()}
    small = [blocks.map(lambda b: (b, None)) for blocks, count in pieces.values() if count <= 1]
    small += [blocks for blocks in cells.values() if blocks is not None]
    fits = [blocks.map(lambda b: (b[0][0], _alone(b[0], loss, settings, begins[b[0][0]], b[1]))) for blocks in small]
    fits += [_drawn_fit(part, *found, starts[part], cuts[part], settings) for part, found in drawn.items() if found is not None]
    alone: dict[int, list[list[GrownTree]]] = {}
    if fits:
        alone = dict(spark.sparkContext.union(fits).collect())
    parts = [part for part in tables if part not in alone]
    if not parts:
        return {part: (starts[part], alone[part], cuts[part]) for part in tables}
    state, earlier = spark.sparkContext.union([pieces[part][0] for part in parts]).persist(StorageLevel.MEMORY_AND_DISK), None
    rounds: dict[int, list[list[GrownTree]]] = {part: [] for part in parts}
    for turn in range(settings.rounds):
        growing = {
            (part, output): Growing(settings, drawn_columns(settings.columns_share, settings.seed, turn, output, len(cuts[part])), begins[part])
            for part in parts
            for output in range(len(starts[part]))
        }
        _grow(state, loss, growing, settings, turn)  # its first pass also fills the cache of a new state
        if earlier is not None:
            earlier.unpersist()
        grown = {key: g.finished() for key, g in growing.items()}
        for part in parts:
            rounds[part].append([grown[part, output] for output in range(len(starts[part]))])
        if turn + 1 < settings.rounds:
            earlier, state = state, state.map(_moved(grown, settings.rate)).persist(StorageLevel.MEMORY_AND_DISK)
            if (turn + 1) % ROUNDS_PER_CHECKPOINT == 0:
                state.checkpoint()
    state.unpersist()
    rounds |= alone
    return {part: (starts[part], rounds[part], cuts[part]) for part in tables}


def counted_fits(train: DataFrame, held: DataFrame, label: str, classes: int) -> Callable[[Settings], DataFrame] | None:
    """For settings: ``cell, y, n, prediction`` of other rows, counted by cell and label, by the booster that ``boost`` would fit on ``train``.

    Both are counted once for all settings; the task that grows the trees also sends the cells of
    the other rows down, and no model is stored. ``None`` for numbers as labels and for too many cells.
    """
    if not classes:
        return None
    loss = LOGISTIC if classes <= 2 else SOFTMAX
    width = train.select(F.size(vector_to_array(F.col(FEATURES)))).first()[0]
    cuts, start = thresholds(train, width), first_margins(loss, train, label, classes)
    if not numberable(cuts):
        return None
    cells = write_table(by_label(counted(train, label, cuts)), "cells")
    others = write_table(by_label(counted(held, label, cuts)), "held-out")
    known = others.select("cell").distinct()
    if max(cells.count(), known.count()) > block_limit(cuts):
        return None
    shared = train.sparkSession.sparkContext.broadcast(np.sort(known.toArrow()["cell"].to_numpy()))
    begins = begins_of(cuts)

    def predicted(settings: Settings) -> DataFrame:
        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filled = [b for b in batches if b.num_rows]
            if not filled:
                return
            rows = pa.Table.from_batches(filled)
            cell, y, n = (rows[c].to_numpy() for c in ("cell", "y", "n"))
            block = (0, cell.view(np.uint64), bins_of(cell, cuts), y, np.repeat(start[:, None], len(y), axis=1))
            bins = bins_of(shared.value, cuts)
            margins = np.repeat(start[:, None], bins.shape[1], axis=1)
            for grown in _alone(block, loss, settings, begins, n):
                margins += settings.rate * np.stack([np.array(t.value)[reached(t, bins)] for t in grown])
            found = margins.argmax(axis=0) if loss == SOFTMAX else margins[0] > 0
            yield pa.RecordBatch.from_arrays([pa.array(shared.value), pa.array(found.astype(float))], ["cell", "prediction"])

        fitted = cells.coalesce(1).sortWithinPartitions("cell", "y").mapInArrow(fit, "cell long, prediction double")
        return others.join(fitted, "cell")

    return predicted


def begins_of(cuts: list[np.ndarray]) -> np.ndarray:
    """Where the bins of each feature begin among those of all."""
    return np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])


def _drawn_fit(part: int, known: np.ndarray, drawn: DataFrame, start: np.ndarray, cuts: list[np.ndarray], settings: Settings) -> RDD:
    """Part and rounds of a fit to ``drawn_cells``, which one task reads round by round."""

    def fit(rows: Iterator) -> Iterator[tuple[int, list[list[GrownTree]]]]:
        block = (part, known.view(np.uint64), bins_of(known, cuts), np.zeros(len(known)), np.repeat(start[:, None], len(known), axis=1))
        yield part, _alone(block, SQUARED, settings, begins_of(cuts), draws=drawn_turns(rows, len(known)))

    return drawn.coalesce(1).sortWithinPartitions("turn", "first").rdd.mapPartitions(fit)


def _moved(grown: dict[tuple[int, int], GrownTree], rate: float):
    """The block after a round: its margins with the new trees."""

    def move(block: Block) -> Block:
        part, keys, bins, label, margins = block
        own = [np.array(grown[part, o].value)[reached(grown[part, o], bins)] for o in range(len(margins))]
        return part, keys, bins, label, margins + rate * np.stack(own)

    return move


# as a stored model

_NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def _metadata(kind: str, uid: str, params: dict, **more) -> str:
    about = {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "uid": uid, "paramMap": params, "defaultParamMap": {}}
    return json.dumps(about | more)


def stored_model(spark: SparkSession, start: float, trees: list[GrownTree], cuts: list[np.ndarray], params: dict, classifier: bool):
    """An MLlib model that predicts ``start`` plus ``stepSize`` times the sum of the trees.

    MLlib's margin of a classifier is half the log-odds.
    """
    scale = 0.5 if classifier else 1.0
    path = fresh_path(spark, "boosted")
    kind = "classification.GBTClassificationModel" if classifier else "regression.GBTRegressionModel"
    version = {"sparkVersion": spark.version}
    constant = GrownTree()
    constant.add(start, trees[0].rows[0] if trees else 1.0)
    nodes, about = [], []
    for number, tree in enumerate([constant, *trees]):
        weight = params["stepSize"] if number else 1.0
        own = _metadata("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", {"maxDepth": params["maxDepth"], "impurity": "variance"}, **version)
        about.append((number, own, weight))
        for i, value in enumerate(tree.value):
            value, rows, leaf = value * scale, tree.rows[i], tree.left[i] < 0
            split = (-1, [], -1) if leaf else (tree.feature[i], [float(cuts[tree.feature[i]][tree.bin[i]])], -1)
            stats = [rows, rows * value, rows * value * value]
            nodes.append((number, (i, value, 0.0, stats, int(rows), float(tree.gain[i]), tree.left[i], tree.right[i], split)))
    uid = f"{'GBTClassifier' if classifier else 'GBTRegressor'}_{uuid.uuid4().hex[:12]}"
    whole = _metadata(kind, uid, params, numFeatures=len(cuts), numTrees=len(trees) + 1, **version)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, _NODES).write.parquet(f"{path}/data")
    return (GBTClassificationModel if classifier else GBTRegressionModel).load(path)


def fit_boosted(tables: Mapping[int, DataFrame], label: str, classes: int, settings: Settings) -> dict:
    """A fitted model per table: a booster, or for more than two classes one margin per class, the largest of which wins."""
    spark = next(iter(tables.values())).sparkSession
    params = {
        "featuresCol": FEATURES, "labelCol": label, "maxIter": settings.rounds, "maxDepth": min(settings.depth or DEEPEST, DEEPEST),
        "stepSize": settings.rate, "subsamplingRate": settings.rows_share, "featureSubsetStrategy": str(settings.columns_share),
        "maxBins": BINS, "impurity": "variance", "minInstancesPerNode": settings.least_rows, "seed": settings.seed,
    }
    found = boost(tables, label, classes, settings)
    stores = [
        lambda start=start, rounds=rounds, cuts=cuts, o=o: stored_model(spark, float(start[o]), [r[o] for r in rounds], cuts, params, classes > 0)
        for start, rounds, cuts in found.values()
        for o in range(len(start))
    ]
    stored = iter(run_jobs(stores))
    models = {}
    for part, (start, _, _) in found.items():
        own = [next(stored) for _ in start]
        if len(own) == 1:
            models[part] = own[0]
        else:
            several = OneVsRestModel(own)
            several.setFeaturesCol(FEATURES)
            several.set(several.labelCol, label)
            models[part] = several
    return models
