import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import boosting as bo
from tabloom.operators.prep import FEATURES


def table(spark, x, y):
    rows = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "_rid long, x array<double>, _label double").withColumn(FEATURES, array_to_vector("x"))


def brute_tree(x, g, h, s):
    """Best splits found by trying every cut of every feature, best leaf first or level by level."""

    def score(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + s.penalty)

    def best(rows):
        found = (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(a), len(b)) < max(1, s.least_rows) or min(h[a].sum(), h[b].sum()) < s.least_weight:
                    continue
                gain = score(a) + score(b) - score(rows)
                if gain > found[0] * (1 + 1e-9):
                    found = (gain, (f, cut, a, b))
        return found

    out = np.zeros(len(x))
    leaves = [(np.arange(len(x)), 0)]
    splits = []
    while True:
        options = [(best(rows), i) for i, (rows, depth) in enumerate(leaves) if depth < (s.depth or 30)]
        options = [(b[0], b[1], i) for b, i in options if b[1]]
        if not options or (s.leaves and len(leaves) == s.leaves):
            break
        gain, (f, cut, a, b), i = max(options, key=lambda o: o[0])
        depth = leaves.pop(i)[1]
        splits.append((f, round(cut, 9), round(gain, 6)))
        leaves += [(a, depth + 1), (b, depth + 1)]
    for rows, _ in leaves:
        out[rows] = -g[rows].sum() / (h[rows].sum() + s.penalty)
    return out, sorted(splits)


def drawn(n=300, seed=1):
    random = np.random.default_rng(seed)
    x = np.column_stack([random.integers(0, 9, n), random.normal(size=n).round(2), random.integers(0, 2, n)])
    return x, 3 * x[:, 0] + x[:, 1] ** 2 * 5 - 4 * x[:, 2] * x[:, 0] + random.normal(size=n)


def of_tree(tree, cuts):
    inner = [i for i, left in enumerate(tree.left) if left >= 0]
    return sorted((tree.feature[i], round(float(cuts[tree.feature[i]][tree.bin[i]]), 9), round(tree.gain[i], 6)) for i in inner)


@pytest.mark.parametrize("settings", [
    bo.Settings(rounds=4, rate=0.3, depth=3),
    bo.Settings(rounds=3, rate=0.3, depth=0, leaves=9, penalty=0.0, least_weight=1e-3, least_rows=5),
    bo.Settings(rounds=2, rate=0.5, depth=2, leaves=20),
])
@pytest.mark.parametrize("block", [64, 1000])
def test_splits_and_margins_equal_brute_force(spark, monkeypatch, settings, block):
    """In passes over several blocks, and in one task over one."""
    monkeypatch.setattr(bo, "BLOCK_ROWS", block)
    monkeypatch.setattr(bo, "FAN", 2)
    monkeypatch.setattr(bo, "AHEAD", 2)
    monkeypatch.setattr(bo, "ROUNDS_PER_CHECKPOINT", 2)
    x, y = drawn()
    start, rounds, cuts = bo.boost({0: table(spark, x, y)}, "_label", 0, settings)[0]
    margin = np.full(len(y), y.mean())
    assert start == pytest.approx([y.mean()])
    for (tree,) in rounds:
        step, splits = brute_tree(x, margin - y, np.ones(len(y)), settings)
        assert of_tree(tree, cuts) == splits
        margin += settings.rate * step
    model = bo.fit_boosted({0: table(spark, x, y)}, "_label", 0, settings)[0]
    found = {r["_rid"]: r["prediction"] for r in model.transform(table(spark, x, y)).collect()}
    assert [found[i] for i in range(len(y))] == pytest.approx(margin)


def test_two_classes_and_several(spark):
    x, y = drawn(400, 3)
    two = (y > 5).astype(float)
    settings = bo.Settings(rounds=5, rate=0.3, depth=3)
    model = bo.fit_boosted({0: table(spark, x, two)}, "_label", 2, settings)[0]
    margin = np.full(len(y), math.log(two.mean() / (1 - two.mean())))
    for _ in range(settings.rounds):
        p = 1 / (1 + np.exp(-margin))
        margin += settings.rate * brute_tree(x, p - two, p * (1 - p), settings)[0]
    rows = {r["_rid"]: r for r in model.transform(table(spark, x, two)).collect()}
    assert [rows[i]["probability"][1] for i in range(len(y))] == pytest.approx(1 / (1 + np.exp(-margin)))
    three = np.digitize(y, [2, 12]).astype(float)
    model = bo.fit_boosted({0: table(spark, x, three)}, "_label", 3, settings)[0]
    margins = np.repeat(np.log([[(three == c).mean()] for c in range(3)]), len(y), axis=1)
    for _ in range(settings.rounds):
        p = np.exp(margins)
        p /= p.sum(axis=0)
        margins = margins + settings.rate * np.stack([brute_tree(x, p[c] - (three == c), p[c] * (1 - p[c]), settings)[0] for c in range(3)])
    rows = {r["_rid"]: r for r in model.transform(table(spark, x, three)).collect()}
    assert [rows[i]["prediction"] for i in range(len(y))] == margins.argmax(axis=0).tolist()


def test_parts_are_fitted_as_if_alone(spark, monkeypatch):
    x, y = drawn(240, 5)
    whole = table(spark, x, y)
    tables = {0: whole.where("_rid % 3 <> 0"), 1: whole.where("_rid % 3 <> 1"), -1: whole}
    settings = bo.Settings(rounds=4, rate=0.3, depth=4, rows_share=0.8, columns_share=0.7)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 200)  # two parts are one block each, the third is two
    together = bo.boost(tables, "_label", 0, settings)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 1000)
    for part, df in tables.items():
        start, rounds, cuts = bo.boost({part: df}, "_label", 0, settings)[part]
        assert [[of_tree(t, cuts) for t in r] for r in rounds] == [[of_tree(t, together[part][2]) for t in r] for r in together[part][1]]


def test_bins(spark):
    random = np.random.default_rng(2)
    x = np.column_stack([np.arange(2000) % 3, random.normal(size=2000), np.full(2000, 7.0)])
    cuts = bo.thresholds(table(spark, x, x[:, 0]), 3)
    assert cuts[0].tolist() == [0.5, 1.5] and len(cuts[2]) == 0
    assert 250 <= len(cuts[1]) <= 255
    shares = np.diff([0, *[(x[:, 1] <= c).mean() for c in cuts[1]], 1])
    assert shares.max() < 0.01


def test_a_label_without_signal_keeps_its_mean(spark):
    x = np.ones((20, 2))
    model = bo.fit_boosted({0: table(spark, x, np.arange(20))}, "_label", 0, bo.Settings(rounds=3))[0]
    assert {r["prediction"] for r in model.transform(table(spark, x, np.arange(20))).collect()} == {9.5}


def test_sampling_is_seeded():
    keys = np.arange(10_000, dtype=np.uint64)
    first = bo.drawn_rows(0.7, 42, 3, keys)
    assert (first == bo.drawn_rows(0.7, 42, 3, keys)).all() and abs(first.mean() - 0.7) < 0.02
    assert (first != bo.drawn_rows(0.7, 42, 4, keys)).any() and bo.drawn_rows(1.0, 42, 3, keys) is None
    assert len(bo.drawn_columns(0.9, 1, 2, 0, 20)) == 18 and len(bo.drawn_columns(0.1, 1, 2, 0, 3)) == 1


def test_features_of_few_bins_are_counted_together():
    random = np.random.default_rng(4)
    sizes = [50, 11, 9, 2, 1, 256, 2, 3]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    bins = np.stack([random.integers(0, s, 3000) for s in sizes]).astype(np.uint8)
    g, h = random.normal(size=3000), random.random(3000)
    bundles = bo.bundles_of(bins, begins)
    assert len(bundles) < len(sizes) / 2 and sorted(f for fs, _, _ in bundles for f in fs) == list(range(len(sizes)))
    rows, columns = np.flatnonzero(random.random(3000) < 0.6), np.array([0, 2, 3, 5, 7])
    for second in (h, None):
        total = bo.row_sums(rows, bundles, columns, begins, g, second)
        for f, size in enumerate(sizes):
            key, part = bins[f][rows], total[:, begins[f] : begins[f + 1]]
            weights = (g[rows], np.ones(len(rows)) if second is None else h[rows], np.ones(len(rows)))
            expected = [np.bincount(key, w, size) for w in weights]
            assert np.allclose(part, expected if f in columns else 0.0)


@pytest.mark.parametrize(("classes", "settings"), [
    (0, bo.Settings(rounds=4, rate=0.3, depth=0, leaves=7, penalty=0.0, least_weight=1e-3, least_rows=5)),
    (2, bo.Settings(rounds=4, rate=0.3, depth=3)),
    (3, bo.Settings(rounds=3, rate=0.3, depth=3, columns_share=0.7)),
])
def test_rows_of_the_same_bins_are_counted(spark, monkeypatch, classes, settings):
    """As many blocks of rows would give, in one block."""
    random = np.random.default_rng(6)
    x = random.integers(0, [7, 4, 2], (900, 3))
    y = x[:, 0] * (1 + x[:, 2]) - x[:, 1] + random.normal(size=900)
    y = np.digitize(y, [3] if classes == 2 else [1, 5]).astype(float) if classes else y
    df = table(spark, x, y)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 7 * 4 * 2 * max(1, classes))
    blocks = bo.blocks_of
    monkeypatch.setattr(bo, "blocks_of", lambda *_: pytest.fail("rows were packed one by one"))
    _, found, cuts = bo.boost({0: df}, "_label", classes, settings)[0]
    monkeypatch.setattr(bo, "blocks_of", blocks)
    monkeypatch.setattr(bo, "counted_block", lambda *_: None)
    _, expected, _ = bo.boost({0: df}, "_label", classes, settings)[0]
    for own, other in zip(found, expected, strict=True):
        for a, b in zip(own, other, strict=True):
            assert of_tree(a, cuts) == of_tree(b, cuts) and a.rows == b.rows and a.value == pytest.approx(b.value)


def test_counted_rows_are_drawn_as_if_one_by_one():
    counts = np.array([1, 10, 100_000])
    drawn = np.stack([bo.drawn_counts(0.9, 42, turn, counts) for turn in range(200)])
    assert (drawn == np.stack([bo.drawn_counts(0.9, 42, turn, counts) for turn in range(200)])).all()
    assert (drawn <= counts).all() and abs(drawn.mean(axis=0) / counts - 0.9).max() < 0.1
    assert 60 < drawn[:, 2].std() < 130 and (bo.drawn_counts(1.0, 42, 0, counts) == counts).all()


@pytest.mark.parametrize("depth", [3, 7])
def test_squared_error_on_drawn_rows_is_fitted_over_cells(spark, monkeypatch, depth):
    """The rows that each round draws are those of blocks of rows, though cells of the same bins are all that trees see."""
    random = np.random.default_rng(8)
    x = random.integers(0, [7, 4, 2], (900, 3))
    y = x[:, 0] * (1 + x[:, 2]) - x[:, 1] + random.normal(size=900)  # labels differ within cells
    df = table(spark, x, y)
    settings = bo.Settings(rounds=5, rate=0.3, depth=depth, rows_share=0.7, columns_share=0.7)
    monkeypatch.setattr(bo, "DRAWN_ROWS", 250)  # cells are shared by tasks
    monkeypatch.setattr(bo, "DRAWN_AT_ONCE", 64)
    blocks = bo.blocks_of
    monkeypatch.setattr(bo, "blocks_of", lambda *_: pytest.fail("rows were packed one by one"))
    _, found, cuts = bo.boost({0: df}, "_label", 0, settings)[0]
    monkeypatch.setattr(bo, "blocks_of", blocks)
    monkeypatch.setattr(bo, "drawn_cells", lambda *_: None)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 400)  # several blocks of rows
    _, expected, _ = bo.boost({0: df}, "_label", 0, settings)[0]
    for (a,), (b,) in zip(found, expected, strict=True):
        assert of_tree(a, cuts) == of_tree(b, cuts) and a.rows == b.rows and a.value == pytest.approx(b.value)


def test_levels_grow_as_nodes_do_one_by_one(monkeypatch):
    random = np.random.default_rng(9)
    sizes = [40, 6, 2, 2, 1, 200]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    bins = np.stack([random.integers(0, s, 2000) for s in sizes]).astype(np.uint8)
    y = bins[0] * (bins[2] + 1.0) - bins[5] / 9 + random.normal(size=2000)
    block = (0, np.arange(2000, dtype=np.uint64), bins, y, np.full((1, 2000), y.mean()))
    settings = bo.Settings(rounds=4, rate=0.3, depth=8, rows_share=0.8, columns_share=0.7)
    monkeypatch.setattr(bo, "LEVEL_SUMS", 3000)  # nodes of a level go in several steps
    found = bo._alone(block, bo.SQUARED, settings, begins)
    monkeypatch.setattr(bo, "LEVEL_ROWS", 0)
    expected = bo._alone(block, bo.SQUARED, settings, begins)
    for (a,), (b,) in zip(found, expected, strict=True):
        assert (a.feature, a.bin, a.left, a.right, a.rows) == (b.feature, b.bin, b.left, b.right, b.rows)
        assert a.value == pytest.approx(b.value) and a.gain == pytest.approx(b.gain)


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("settings", [
    bo.Settings(rounds=5, rate=0.3, depth=3, rows_share=0.8, columns_share=0.7),
    bo.Settings(rounds=4, rate=0.3, depth=0, leaves=7, penalty=0.0, least_weight=1e-3, least_rows=5),
])
def test_held_out_rows_are_predicted_as_by_the_stored_booster(spark, monkeypatch, classes, settings):
    random = np.random.default_rng(6)
    x = random.integers(0, [7, 4, 2], (900, 3))
    y = x[:, 0] * (1 + x[:, 2]) - x[:, 1] + random.normal(size=900)
    df = table(spark, x, np.digitize(y, [3] if classes == 2 else [1, 5]).astype(float))
    train, held = df.where("_rid % 3 > 0"), df.where("_rid % 3 = 0")
    model = bo.fit_boosted({0: train}, "_label", classes, settings)[0]
    expected = model.transform(held).groupBy("_label").agg(F.sum("prediction")).orderBy("_label").collect()
    monkeypatch.setattr(bo, "stored_model", lambda *_: pytest.fail("a model was stored"))
    found = bo.counted_fits(train, held, "_label", classes)(settings).toPandas()
    assert found["n"].sum() == 300
    assert (found["prediction"] * found["n"]).groupby(found["y"]).sum().to_dict() == {r[0]: r[1] for r in expected}
