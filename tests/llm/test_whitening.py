import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import whitening

RNG = np.random.default_rng(7)
TURN = np.linalg.qr(RNG.normal(size=(24, 24)))[0]
MATRICES = {
    "one": np.array([[3.0]]),
    "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    "singular": np.ones((6, 6)),
    "zero": np.zeros((4, 4)),
    "identity": 3 * np.eye(7),
    "repeated": np.diag([5.0, 5, 5, 1, 1, 0, 0]),
    "graded": TURN @ np.diag(np.logspace(0, -14, 24)) @ TURN.T,
    "cluster": TURN @ np.diag(np.r_[1 + 1e-13 * np.arange(10), RNG.random(14)]) @ TURN.T,
    "random": np.cov(RNG.normal(size=(24, 100))),
    "wide": np.cov(RNG.normal(size=(90, 300)) * RNG.lognormal(size=(90, 1))),
}


@pytest.mark.parametrize("name", MATRICES)
def test_eigenvectors(name):
    a = MATRICES[name]
    values, vectors = whitening.eigenvectors(a)
    scale = np.linalg.norm(a) + 1e-300
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-14 * scale)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-14 * max(4, len(a))
    assert np.abs(a @ vectors - vectors * values).max() < 2e-14 * scale


def test_polar_factor_is_the_sign():
    a = TURN @ np.diag(np.r_[np.logspace(0, -9, 12), -np.logspace(0, -9, 12)]) @ TURN.T
    u = whitening.polar_factor(a)
    assert np.abs(u @ u - np.eye(24)).max() < 1e-13 and np.abs(u - TURN @ np.diag(np.r_[np.ones(12), -np.ones(12)]) @ TURN.T).max() < 1e-6


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}")


def drawn(n=300, d=12):
    x = RNG.normal(size=(n, d)) * np.linspace(0.2, 1.5, d) + RNG.normal(size=d)
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def brute(rows, most):
    """Deviations with whole numbers of any size, and what the components must give up to their sign."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > 1e-9 * values[0]).sum()))
    return [i for i, _ in good], n, deviation, centred @ vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()


@pytest.mark.parametrize("most", [3, 32])
def test_whitened_rows_equal_brute_force(spark, most):
    rows = drawn() + [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("-inf")] + [0.0] * 11), (None, [0.5] * 12), (5, [0.25] * 12), (5, [0.25] * 12)]
    docs = frame(spark, rows).withColumns({"x": F.lit(1), "ID": F.lit(2), "component": F.lit(3), "whitened": F.lit("w")})
    vectors = whitening.whole_numbers(docs).repartition(5)
    fitted = whitening.fit(vectors, most)
    ids, n, deviation, white, explained = brute(rows, most)
    assert fitted.n == n and fitted.identity_error < 1e-10
    found = {}
    for r in whitening.whiten(vectors, fitted).collect():
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert sum(len(x) for c in found.values() for x in c.values()) == n * len(explained)
    sign = None
    for i, d, w in zip(ids, deviation, white):
        mine = found[i, d]
        assert sorted(mine) == list(range(1, len(w) + 1))
        got = np.array([mine[c][0].whitened for c in sorted(mine)])
        sign = np.sign(got * w) if sign is None else sign
        assert np.allclose(got * sign, w, atol=1e-8)
        assert np.allclose([mine[c][0].explained for c in sorted(mine)], explained, rtol=1e-10)


def test_tables_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        vectors = whitening.whole_numbers(frame(spark, rows))
        fitted = whitening.fit(vectors)
        assert len(fitted.values) == 0 and whitening.whiten(vectors, fitted).collect() == []
    # fewer rows than entries: as many components as there is rank
    vectors = whitening.whole_numbers(frame(spark, drawn(4)))
    fitted = whitening.fit(vectors)
    assert len(fitted.values) == 3 and fitted.identity_error < 1e-9


def test_what_is_refused(spark):
    with pytest.raises(ValueError):
        whitening.fit(whitening.whole_numbers(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])])))
    huge = whitening.whole_numbers(frame(spark, [(i, [1e13 * i, 1.0]) for i in range(2000)], "array<double>"))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(huge, whitening.fit(huge)).collect()
