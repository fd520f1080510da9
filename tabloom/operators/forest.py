"""Random forests over cells: rows are counted by the bins of their features, and each tree grows in a task of its own.

A tree sees of a row only its bins and its label, so a bootstrap sample is told by
how often it takes the rows of each cell and label: Poisson numbers by their count,
as if every row drew its own. Up to ``DRAWN_ROWS`` counted rows are sent to every task, whose
tree draws for itself; more are drawn by many tasks, for all trees, and summed
by cell. What a tree is sent follows the cells, which bins and features bound. Tables
of more than ``MOST_CELLS`` cells are left to MLlib. Bins, impurities, stopping rules and
the pruning of equal leaves are those of MLlib's forests, and so is the stored form.

Where only the score on other rows is wanted, the tasks that grow the trees also send the
cells of those rows down, and no forest is stored. A forest of more than ``MOST_NODES`` nodes
stays in the shared folder (``RandomForestOnDisk``): the driver does not hold it, and tasks that
read some of its trees send the cells of the rows to score down.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.arrays import to_lists, to_matrix
from tabloom.operators.boosting import _NODES, _metadata, thresholds
from tabloom.operators.cells import bin_counts, bins_of, by_label, cells_at, counted, numberable
from tabloom.operators.prep import FEATURES
from tabloom.session import fresh_path, write_table

MOST_CELLS = 1_000_000
# sums that a tree holds of its cells, and of the nodes that it splits at a time
MOST_SUMS, NODE_SUMS = 16_000_000, 4_000_000
# counted rows that one task draws
DRAWN_ROWS = 500_000
# votes of a tree that are added up to those of the others together
VOTES_AT_ONCE = 16_384
UNEVEN = 1e-12
# nodes that the driver holds as MLlib's model
MOST_NODES = 500_000
# trees of a stored forest that one task reads to score rows
TREES_PER_TASK = 4
_TREES = "tree int, nodes int, feature binary, bin binary, left binary, gain binary, sums binary"


@dataclass(frozen=True)
class Growth:
    """How the trees of a forest grow; ``classes`` is 0 for a number as label."""

    classes: int
    depth: int
    tried: int
    least_rows: int
    least_gain: float
    rate: float
    seed: int


@dataclass(frozen=True)
class Cells:
    """Rows to fit on, counted by cell and label; ``few`` has them (cells, their places, labels, counts) if one task can draw them."""

    table: DataFrame
    rows: int
    cuts: list[np.ndarray]
    width: int
    few: Broadcast | None


@dataclass
class Nodes:
    """Nodes of a tree, level by level, the root first; ``left`` is -1 for a leaf. A row goes left if its bin is ``bin`` at most."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    gain: np.ndarray
    sums: np.ndarray  # nodes x (classes, or rows, labels and their squares)


def tried_features(strategy: str, classifier: bool, trees: int, width: int) -> int:
    """How many features a node tries, as MLlib reads ``featureSubsetStrategy``."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classifier else "onethird"
    if strategy == "all":
        return width
    if strategy in ("sqrt", "log2", "onethird"):
        return {"sqrt": lambda: math.ceil(math.sqrt(width)), "log2": lambda: max(1, math.ceil(math.log2(width))), "onethird": lambda: math.ceil(width / 3)}[strategy]()
    if "." in strategy:
        return math.ceil(float(strategy) * width)
    return min(int(strategy), width)


def rows_in(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(axis=0) if classes else sums[0]


def spread_of(sums: np.ndarray, classes: int) -> np.ndarray:
    """Impurity times rows: Gini's, or the squared deviations."""
    n = np.maximum(rows_in(sums, classes), 1e-300)
    return n - np.square(sums).sum(axis=0) / n if classes else sums[2] - np.square(sums[1]) / n


def prediction_of(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.argmax(axis=0).astype(float) if classes else sums[1] / np.maximum(sums[0], 1e-300)


def best_splits(bins: np.ndarray, at: np.ndarray, sums: np.ndarray, totals: np.ndarray, idle: np.ndarray, growth: Growth, random) -> tuple[np.ndarray, ...]:
    """Gain (``-inf``: none), feature and bin for each of some nodes but the ``idle``; ``at`` has the node of each cell, in rising order.

    Of a feature only the nodes are looked at that hold several of its bins, from the first that they hold.
    """
    count, width = totals.shape[1], len(bins)
    tried = random.random((count, width)).argsort(axis=1).argsort(axis=1) < growth.tried
    gain, feature, cut = np.full(count, -np.inf), np.full(count, -1), np.full(count, -1)
    if not len(at):
        return gain, feature, cut
    whole, n = spread_of(totals, growth.classes), rows_in(totals, growth.classes)
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    filled, cells = at[begins], np.diff(np.append(begins, len(at)))
    for f in range(width):
        low, high = np.minimum.reduceat(bins[f], begins), np.maximum.reduceat(bins[f], begins)
        open_ = (high > low) & tried[filled, f] & ~idle[filled]
        if not open_.any():
            continue
        nodes, some = filled[open_], np.flatnonzero(np.repeat(open_, cells))
        size = int((high[open_] - low[open_]).max()) + 1
        key = np.repeat(np.arange(len(nodes)) * size - low[open_], cells[open_]) + bins[f].take(some)
        left = np.stack([np.bincount(key, s.take(some), len(nodes) * size).reshape(len(nodes), size) for s in sums]).cumsum(axis=2)[:, :, :-1]
        right = totals[:, nodes, None] - left
        own = (whole[nodes, None] - spread_of(left, growth.classes) - spread_of(right, growth.classes)) / n[nodes, None]
        fits = np.minimum(rows_in(left, growth.classes), rows_in(right, growth.classes)) >= max(1, growth.least_rows)
        own = np.where(fits, own, -np.inf)
        best = own.argmax(axis=1)
        value = own[np.arange(len(nodes)), best]
        better = value > gain[nodes]
        at_best = nodes[better]
        gain[at_best], feature[at_best], cut[at_best] = value[better], f, (best + low[open_])[better]
    return gain, feature, cut


def grow_tree(bins: np.ndarray, sizes: list[int], sums: np.ndarray, growth: Growth, random) -> Nodes:
    """One tree from the sums of each cell (sums x cells)."""
    found, first, node = [], 0, np.zeros(bins.shape[1], np.int64)
    totals = sums.sum(axis=1, keepdims=True)
    for depth in range(growth.depth + 1):
        count = totals.shape[1]
        gain, feature, cut = np.full(count, -np.inf), np.full(count, -1), np.full(count, -1)
        spread = spread_of(totals, growth.classes)
        pure = spread <= UNEVEN * (rows_in(totals, growth.classes) if growth.classes else totals[2])
        if depth < growth.depth:
            # short numbers are sorted by radix
            order = np.argsort(node.astype(np.uint16) if count <= 2**16 else node, kind="stable")
            ends = np.searchsorted(node[order], np.arange(count + 1))
            chunk = max(1, NODE_SUMS // (max(sizes) * len(sums)))
            for a in range(0, count, chunk):
                b = min(count, a + chunk)
                rows = order[ends[a] : ends[b]]
                gain[a:b], feature[a:b], cut[a:b] = best_splits(bins.take(rows, axis=1), node[rows] - a, sums.take(rows, axis=1), totals[:, a:b], pure[a:b], growth, random)
        least = np.maximum(UNEVEN * spread / np.maximum(rows_in(totals, growth.classes), 1e-300), 0.0)
        splits = ~pure & (gain > least) & (gain >= growth.least_gain)
        place = np.cumsum(splits) - 1
        left = np.where(splits, first + count + 2 * place, -1)
        found.append(Nodes(np.where(splits, feature, -1), np.where(splits, cut, -1), left, np.where(splits, left + 1, -1), np.where(splits, gain, -1.0), totals.T))
        if not splits.any():
            break
        going = np.flatnonzero(splits[node])
        bins, sums, node = bins.take(going, axis=1), sums.take(going, axis=1), node[going]
        right = bins[feature[node], np.arange(len(node))] > cut[node]
        node = 2 * place[node] + right
        first += count
        totals = np.stack([np.bincount(node, s, 2 * int(splits.sum())) for s in sums])
    return pruned(found, growth.classes)


def pruned(levels: list[Nodes], classes: int) -> Nodes:
    """The tree without splits into two leaves that predict the same."""
    whole = Nodes(*[np.concatenate([getattr(level, name) for level in levels]) for name in ("feature", "bin", "left", "right", "gain", "sums")])
    guess = prediction_of(whole.sums.T, classes)
    begins = np.cumsum([0, *[len(level.left) for level in levels]])
    for a, b in reversed(list(zip(begins, begins[1:]))):
        inner = a + np.flatnonzero(whole.left[a:b] >= 0)
        l, r = whole.left[inner], whole.right[inner]
        same = inner[(whole.left[l] < 0) & (whole.left[r] < 0) & (guess[l] == guess[r])]
        whole.left[same] = whole.right[same] = whole.feature[same] = whole.bin[same] = -1
        whole.gain[same] = -1.0
    kept = np.zeros(len(whole.left), bool)
    kept[0] = True
    for a, b in zip(begins, begins[1:]):
        inner = a + np.flatnonzero(kept[a:b] & (whole.left[a:b] >= 0))
        kept[whole.left[inner]] = kept[whole.right[inner]] = True
    number = np.cumsum(kept) - 1
    own = Nodes(*[getattr(whole, name)[kept] for name in ("feature", "bin", "left", "right", "gain", "sums")])
    inner = own.left >= 0
    own.left[inner], own.right[inner] = number[own.left[inner]], number[own.right[inner]]
    return own


def node_table(tree: int, nodes: Nodes, cuts: list[np.ndarray], classes: int) -> pa.Table:
    """Rows of the stored form of MLlib's forests."""
    sums, count = nodes.sums.T, len(nodes.left)
    n = rows_in(sums, classes)
    inner = nodes.left >= 0
    at = [[float(cuts[f][b])] if f >= 0 else [] for f, b in zip(nodes.feature.tolist(), nodes.bin.tolist())]
    split = pa.StructArray.from_arrays(
        [pa.array(nodes.feature, pa.int32()), pa.array(at, pa.list_(pa.float64())), pa.array(np.full(count, -1), pa.int32())],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    columns = {
        "id": pa.array(range(count), pa.int32()),
        "prediction": pa.array(prediction_of(sums, classes)),
        "impurity": pa.array(np.maximum(spread_of(sums, classes), 0.0) / np.maximum(n, 1e-300)),
        "impurityStats": pa.array(list(nodes.sums), pa.list_(pa.float64())),
        "rawCount": pa.array(n.astype(np.int64)),
        "gain": pa.array(np.where(inner, nodes.gain, -1.0)),
        "leftChild": pa.array(nodes.left, pa.int32()),
        "rightChild": pa.array(nodes.right, pa.int32()),
        "split": split,
    }
    return pa.table({"treeID": pa.array(np.full(count, tree), pa.int32()), "nodeData": pa.StructArray.from_arrays(list(columns.values()), list(columns))})


def packed_tree(tree: int, nodes: Nodes) -> pa.Table:
    """A row of ``_TREES``; the right child of a node follows the left one."""
    columns = (nodes.feature.astype(np.int32), nodes.bin.astype(np.int32), nodes.left.astype(np.int32), nodes.gain, nodes.sums)
    kept = {name: pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for name, c in zip(("feature", "bin", "left", "gain", "sums"), columns)}
    return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([len(nodes.left)], pa.int32())} | kept)


def unpacked_trees(batch: pa.RecordBatch) -> Iterator[tuple[int, Nodes]]:
    for row in range(batch.num_rows):
        tree, count = (batch.column(c)[row].as_py() for c in ("tree", "nodes"))
        feature, cut, left = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32).astype(np.int64) for c in ("feature", "bin", "left"))
        gain, sums = (np.frombuffer(batch.column(c)[row].as_buffer(), float) for c in ("gain", "sums"))
        yield tree, Nodes(feature, cut, left, np.where(left >= 0, left + 1, -1), gain, sums.reshape(count, -1))


def node_rows(trees: DataFrame, cuts: list[np.ndarray], classes: int) -> DataFrame:
    """The nodes of packed trees as rows of MLlib's stored form."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, nodes in unpacked_trees(batch):
                yield from node_table(tree, nodes, cuts, classes).to_batches()

    return trees.mapInArrow(unpack, _NODES)


def sample_sums(place: np.ndarray, y: np.ndarray, n: np.ndarray, cells: int, growth: Growth, tree: int, task: int) -> np.ndarray:
    """Sums x cells of the sample that a tree takes of the counted rows of a task."""
    taken = np.random.default_rng([growth.seed, tree, task]).poisson(n * growth.rate).astype(float)
    if growth.classes:
        return np.bincount(y.astype(np.int64) * cells + place, taken, growth.classes * cells).reshape(growth.classes, -1)
    return np.stack([np.bincount(place, taken * y**power, cells) for power in range(3)])


def drawn_sums(cells: DataFrame, trees: int, growth: Growth) -> DataFrame:
    """``tree, cells, sums``: what the sample of each tree holds of the cells of each task."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        held = pa.Table.from_batches(filled)
        y, n, task = (held[c].to_numpy() for c in ("y", "n", "task"))
        cell, place = np.unique(held["cell"].to_numpy(), return_inverse=True)
        for tree in range(trees):
            sums = sample_sums(place, y, n, len(cell), growth, tree, int(task[0]))
            some = rows_in(sums, growth.classes) > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int32()), pa.array([int(task[0])], pa.int32()), pa.array([cell[some].tobytes()], pa.binary()), pa.array([sums[:, some].tobytes()], pa.binary())],
                ["tree", "task", "cells", "sums"],
            )

    return cells.mapInArrow(draw, "tree int, task int, cells binary, sums binary")


def forest_cells(df: DataFrame, label: str, classes: int, settings: dict) -> Cells | None:
    """What all forests on some rows share; ``None`` where the rows have too many cells or samples are not drawn."""
    if not settings["bootstrap"]:
        return None
    width = df.select(F.size(vector_to_array(F.col(FEATURES)))).first()[0]
    cuts = thresholds(df, width, settings["maxBins"])
    if not numberable(cuts):
        return None
    cells = write_table(by_label(counted(df, label, cuts)), "cells")
    rows, known = cells.count(), cells.select("cell").distinct().count()
    if known > MOST_CELLS or known * (classes or 3) > MOST_SUMS:
        return None
    few = None
    if rows <= DRAWN_ROWS:
        held = cells.coalesce(1).sortWithinPartitions("cell", "y").toArrow()
        few = df.sparkSession.sparkContext.broadcast(
            (*np.unique(held["cell"].to_numpy(), return_inverse=True), held["y"].to_numpy(), held["n"].to_numpy())
        )
    return Cells(cells, rows, cuts, width, few)


def growth_of(cells: Cells, classes: int, settings: dict) -> Growth:
    tried = tried_features(settings["featureSubsetStrategy"], classes > 0, settings["numTrees"], cells.width)
    return Growth(classes, settings["maxDepth"], tried, settings["minInstancesPerNode"], settings["minInfoGain"], settings["subsamplingRate"], settings["seed"])


def grown(cells: Cells, classes: int, settings: dict, finish: Callable[[int, Nodes], pa.Table], schema: str) -> DataFrame:
    """``finish(number, nodes)`` of every tree, each grown in a task of its own."""
    trees, growth = settings["numTrees"], growth_of(cells, classes, settings)
    kinds, cuts, few = classes or 3, cells.cuts, cells.few
    sizes = bin_counts(cuts)

    def one(tree: int, cell: np.ndarray, sums: np.ndarray) -> pa.Table:
        return finish(tree, grow_tree(bins_of(cell, cuts), sizes, sums, growth, np.random.default_rng([growth.seed, tree])))

    if few is not None:

        def draw_and_grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree in batch.column("id").to_pylist():
                    cell, place, y, n = few.value
                    sums = sample_sums(place, y, n, len(cell), growth, tree, 0)
                    some = rows_in(sums, classes) > 0
                    yield from one(tree, cell[some], sums[:, some]).to_batches()

        return cells.table.sparkSession.range(0, trees, 1, trees).mapInArrow(draw_and_grow, schema)

    tasks = -(-cells.rows // DRAWN_ROWS)
    spread = cells.table.repartition(tasks, "cell", "y").sortWithinPartitions("cell", "y").withColumn("task", F.spark_partition_id())

    def grow(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("task")
        cell = np.concatenate([np.frombuffer(c.as_py(), np.int64) for c in parts["cells"]])
        sums = np.concatenate([np.frombuffer(s.as_py(), float).reshape(kinds, -1) for s in parts["sums"]], axis=1)
        if len(parts) > 1:
            cell, place = np.unique(cell, return_inverse=True)
            sums = np.stack([np.bincount(place, s, len(cell)) for s in sums])
        return one(parts["tree"][0].as_py(), cell, sums)

    drawn = drawn_sums(spread, trees, growth).repartition(trees, "tree")
    return drawn.groupBy("tree").applyInArrow(grow, schema)


def fit_forest(df: DataFrame, label: str, classes: int, settings: dict):
    """A forest of MLlib's kind, or one on disk if it is large, or ``None`` where ``forest_cells`` has none; ``settings`` are those of the estimator."""
    cells = forest_cells(df, label, classes, settings)
    if cells is None:
        return None
    trees = write_table(grown(cells, classes, settings, packed_tree, _TREES), "trees")
    if trees.agg(F.sum("nodes")).first()[0] > MOST_NODES:
        return (RandomForestClassesOnDisk if classes else RandomForestOnDisk)(trees, cells.cuts, classes, settings)
    return stored_forest(df.sparkSession, node_rows(trees, cells.cuts, classes), classes, cells.width, settings)


def votes_of(nodes: Nodes, bins: np.ndarray, classes: int) -> np.ndarray:
    """What a tree says of each cell: shares of the classes, or one number (outputs x cells)."""
    at, going = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while True:
        going = going[nodes.left[at[going]] >= 0]
        if not len(going):
            break
        node = at[going]
        left = bins[nodes.feature[node], going] <= nodes.bin[node]
        at[going] = np.where(left, nodes.left[node], nodes.right[node])
    sums = nodes.sums.T
    said = sums / np.maximum(sums.sum(axis=0), 1e-300) if classes else prediction_of(sums, 0)[None, :]
    return said[:, at]


def held_out(cells: Cells, held: DataFrame, label: str, classes: int) -> Callable[[dict], DataFrame] | None:
    """For the settings of a forest on ``cells``: ``cell, y, n, prediction`` of other rows, counted by cell and label.

    A forest predicts the same for all rows of a cell. ``None`` where the other
    rows have too many cells.
    """
    cuts = cells.cuts
    others = write_table(by_label(counted(held, label, cuts)), "held-out")
    known = others.select("cell").distinct()
    count = known.count()
    if count > MOST_CELLS or count * max(1, classes) > MOST_SUMS:
        return None
    shared = held.sparkSession.sparkContext.broadcast(np.sort(known.toArrow()["cell"].to_numpy()))
    step = max(1, VOTES_AT_ONCE // max(1, classes))

    def predicted(settings: dict) -> DataFrame:
        def vote(tree: int, nodes: Nodes) -> pa.Table:
            begins = range(0, count, step)
            parts = [votes_of(nodes, bins_of(shared.value[a : a + step], cuts), classes) for a in begins]
            return pa.table(
                {
                    "tree": pa.array(np.full(len(parts), tree), pa.int32()),
                    "begin": pa.array(begins, pa.int32()),
                    "votes": pa.array([p.tobytes() for p in parts], pa.binary()),
                }
            )

        def add(parts: pa.Table) -> pa.Table:
            begin = parts["begin"][0].as_py()
            cell = shared.value[begin : begin + step]
            total = np.zeros((max(1, classes), len(cell)))
            for votes in parts.sort_by("tree")["votes"]:
                total += np.frombuffer(votes.as_buffer(), float).reshape(total.shape)
            found = total.argmax(axis=0).astype(float) if classes else total[0] / len(parts)
            return pa.table({"cell": pa.array(cell), "prediction": pa.array(found)})

        votes = grown(cells, classes, settings, vote, "tree int, begin int, votes binary")
        return others.join(votes.groupBy("begin").applyInArrow(add, "cell long, prediction double"), "cell")

    return predicted


def stored_forest(spark: SparkSession, nodes: DataFrame, classes: int, width: int, settings: dict):
    """An MLlib model of the trees."""
    path = fresh_path(spark, "forest")
    task = "classification" if classes else "regression"
    tree = f"{task}.DecisionTree{'Classification' if classes else 'Regression'}Model"
    version = {"sparkVersion": spark.version, "numFeatures": width}
    if classes:
        version["numClasses"] = classes
    own = {"maxDepth": settings["maxDepth"], "impurity": settings["impurity"]}
    trees = settings["numTrees"]
    about = [(t, _metadata(tree, f"dt_{path[-12:]}_{t}", own, **version), 1.0) for t in range(trees)]
    nodes.write.parquet(f"{path}/data")
    kind = tree.replace("DecisionTree", "RandomForest")
    whole = _metadata(kind, f"forest_{path[-12:]}", settings, numTrees=trees, **version)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(path)


# parameters that a forest on disk has in common with MLlib's
KEPT = (
    "numTrees", "maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "subsamplingRate", "featureSubsetStrategy", "impurity", "bootstrap",
    "seed", "featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol",
)


class RandomForestOnDisk(Model, MLWritable, MLReadable):
    """A regression forest whose trees stay in the shared folder; what it predicts is what MLlib's model of the same trees does."""

    def __init__(self, trees: DataFrame | None = None, cuts: list[np.ndarray] | None = None, classes: int = 0, settings: dict | None = None):
        super().__init__()
        self.table, self.cuts, self.classes, self.settings = trees, cuts, classes, settings
        if settings:
            self._set(**{name: settings[name] for name in KEPT if name in settings})

    @property
    def numFeatures(self) -> int:
        return len(self.cuts)

    @property
    def getNumTrees(self) -> int:
        return self.settings["numTrees"]

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * self.getNumTrees

    def loaded(self):
        """MLlib's model, which the driver holds."""
        return stored_forest(self.table.sparkSession, node_rows(self.table, self.cuts, self.classes), self.classes, self.numFeatures, self.settings)

    @property
    def trees(self) -> list:
        return self.loaded().trees

    def votes(self, known: np.ndarray) -> DataFrame:
        """``_cell, _votes``: the sum over the trees of what they say of some cells."""
        spark, cuts, classes = self.table.sparkSession, self.cuts, self.classes
        shared, step = spark.sparkContext.broadcast(known), max(1, VOTES_AT_ONCE // max(1, classes))

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, first = None, None
            bins = bins_of(shared.value, cuts)
            for batch in batches:
                for tree, nodes in unpacked_trees(batch):
                    if total is None:
                        total, first = np.zeros((max(1, classes), len(shared.value))), tree
                    for a in range(0, len(shared.value), step):
                        total[:, a : a + step] += votes_of(nodes, bins[:, a : a + step], classes)
            for a in range(0, len(shared.value) if total is not None else 0, step):
                own = pa.array([np.ascontiguousarray(total[:, a : a + step]).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([a], pa.int32()), own], ["tree", "begin", "votes"])

        def add(parts: pa.Table) -> pa.Table:
            begin = parts["begin"][0].as_py()
            cell = shared.value[begin : begin + step]
            total = np.zeros((max(1, classes), len(cell)))
            for votes in parts.sort_by("tree")["votes"]:
                total += np.frombuffer(votes.as_buffer(), float).reshape(total.shape)
            return pa.table({"_cell": pa.array(cell), "_votes": to_lists(total.T)})

        tasks = -(-self.getNumTrees // TREES_PER_TASK)
        spread = self.table.select("tree", "nodes", "feature", "bin", "left", "gain", "sums").repartition(tasks, "tree").sortWithinPartitions("tree")
        return spread.mapInArrow(vote, "tree int, begin int, votes binary").groupBy("begin").applyInArrow(add, "_cell long, _votes array<double>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts = self.cuts
        if dataset.isStreaming:
            return self.loaded().transform(dataset)

        @F.arrow_udf("long")
        def cell_of(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in vectors:
                yield pa.array(cells_at(to_matrix(batch), cuts) if len(batch) else np.empty(0, np.int64))

        rows = dataset.withColumn("_cell", cell_of(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
        known = write_table(rows.select("_cell").distinct(), "cells")
        count = known.count()
        if count > MOST_CELLS or count * max(1, self.classes) > MOST_SUMS:
            return self.loaded().transform(dataset)
        found = self.votes(np.sort(known.toArrow()["_cell"].to_numpy()))
        return self.told(rows.join(found, "_cell")).drop("_cell", "_votes")

    def told(self, rows: DataFrame) -> DataFrame:
        """``_votes`` as the columns of a prediction."""
        return rows.withColumn(self.getOrDefault("predictionCol"), F.get("_votes", F.lit(0)) / F.lit(float(self.getNumTrees)))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class RandomForestClassesOnDisk(RandomForestOnDisk):
    """The same for classes."""

    @property
    def numClasses(self) -> int:
        return self.classes

    def told(self, rows: DataFrame) -> DataFrame:
        total = F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b)
        shares = F.transform("_votes", lambda v: v / total)
        guess = (F.array_position("_votes", F.array_max("_votes")) - F.lit(1)).cast("double")
        named = (("rawPredictionCol", array_to_vector(F.col("_votes"))), ("probabilityCol", array_to_vector(shares)), ("predictionCol", guess))
        return rows.withColumns({self.getOrDefault(name): column for name, column in named})


for _name in KEPT:
    setattr(RandomForestOnDisk, _name, Param(Params._dummy(), _name, _name))


class _Writer(MLWriter):
    def __init__(self, instance: RandomForestOnDisk):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        """The trees packed, and as MLlib's nodes in ``data``."""
        own = self.instance
        about = {"cuts": [c.tolist() for c in own.cuts], "classes": own.classes, "settings": own.settings}
        DefaultParamsWriter.saveMetadata(own, path, self.sc, extraMetadata={"forest": about})
        own.table.write.parquet(path + "/trees")
        node_rows(own.table, own.cuts, own.classes).write.parquet(path + "/data")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> RandomForestOnDisk:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        about = metadata["forest"]
        trees = SparkSession.getActiveSession().read.parquet(path + "/trees")
        model = self.cls(trees, [np.array(c) for c in about["cuts"]], about["classes"], about["settings"])
        model._resetUid(metadata["uid"])
        return model
