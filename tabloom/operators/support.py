"""Linear support vectors over random Fourier features, by Newton steps on a hinge whose corner is rounded ever less.

The objective is that of MLlib's ``LinearSVC``: the mean hinge loss and a penalty on the weights of
scaled features. The corner of the hinge is replaced by a parabola over a margin of width
``h`` to both sides, which lies at most ``h / 4`` above; ``h`` falls until that is less than the
tolerance. Rows near the corner give the second derivative, a matrix whose size follows the
features. A pass draws the Fourier features anew (``operators/huber.py``); none is stored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.huber import SHARES, scaling, solved, stored

# how far the corner is rounded to both sides at first, and what is left of it at each narrowing
WIDE, NARROWED = 2.0, 0.3
# least rounding: beyond it the tolerance asks for more than doubles give
NARROWEST = 1e-6
# a mean loss that the tolerance refers to at least; it is 1 without any weight
LEAST_LOSS = 1e-2
# damping of a step, as a share of the mean second derivative
DAMPED, LEAST_DAMPED = 1e-6, 1e-12


def hinge_parts(z: np.ndarray, y: np.ndarray, n: np.ndarray, scaled: np.ndarray, at: np.ndarray, h: float) -> np.ndarray:
    """Hinge loss, rounded loss, rows near the corner, the gradient and the products of pairs of features over those rows; ``y`` is -1 or 1."""
    z = np.column_stack([z * scaled, np.ones(len(z))])
    gap = 1.0 - y * (z @ at)
    near = np.abs(gap) <= h
    slope = np.where(near, (gap + h) / (2 * h), (gap > 0).astype(float))
    rounded = np.where(near, (gap + h) ** 2 / (4 * h), np.maximum(gap, 0.0))
    own = z[near]
    products = (own * (n[near] / (2 * h))[:, None]).T @ own
    head = [n @ np.maximum(gap, 0.0), n @ rounded, n[near].sum()]
    return np.concatenate([head, -(n * slope * y) @ z, products.ravel()])


def hinge_losses(z: np.ndarray, y: np.ndarray, n: np.ndarray, scaled: np.ndarray, at: np.ndarray, step: np.ndarray, h: float) -> np.ndarray:
    """The rounded loss at ``SHARES`` of the way along ``step``."""
    z = z * scaled
    gap, way = 1.0 - y * (z @ at[:-1] + at[-1]), y * (z @ step[:-1] + step[-1])
    found = []
    for share in SHARES:
        own = gap - share * way
        found.append(n @ np.where(np.abs(own) <= h, (own + h) ** 2 / (4 * h), np.maximum(own, 0.0)))
    return np.array(found)


def descend(look: Callable, compare: Callable, width: int, rows: float, penalty: float, iterations: int, tolerance: float) -> np.ndarray:
    """Weights and intercept; ``look(at, h)`` and ``compare(at, step, h)`` sum ``hinge_parts`` and ``hinge_losses`` over all rows."""
    ridge = np.append(np.full(width - 1, penalty), 0.0)  # not on the intercept
    at, h, damped = np.zeros(width), WIDE, DAMPED

    def at_point(point: np.ndarray, h: float):
        sums = look(point, h)
        held = 0.5 * float(ridge @ point**2)
        gradient = sums[3 : 3 + width] / rows + ridge * point
        hessian = sums[3 + width :].reshape(width, width) / rows + np.diag(ridge)
        return sums[0] / rows + held, sums[1] / rows + held, sums[2] / rows, gradient, hessian

    found, best = at_point(at, h), (np.inf, at)
    whole = False  # the last step was taken whole
    for _ in range(iterations):
        exact, objective, near, gradient, hessian = found
        best = min(best, (exact, at), key=lambda b: b[0])
        scale = max(np.trace(hessian) / width, 1e-300)
        step = -np.linalg.lstsq(hessian + damped * scale * np.eye(width), gradient, rcond=None)[0]
        promise = -float(gradient @ step) / 2
        allowed = tolerance * max(exact, LEAST_LOSS)
        # what the rounding adds at most, beside what steps of this rounding can still give
        if promise <= max(allowed / 2, near * h / 4):
            if near * h / 4 <= allowed or h <= NARROWEST:
                break
            h *= NARROWED
            found = at_point(at, h)
            continue
        if whole:
            tried = at_point(at + step, h)
            if tried[1] < objective - promise / 2:
                at, found, damped = at + step, tried, max(LEAST_DAMPED, damped / 10)
                continue
        reached = compare(at, step, h) / rows + [0.5 * float(ridge @ (at + s * step) ** 2) for s in SHARES]
        chosen = int(np.argmin(reached))
        whole = chosen == 0
        if reached[chosen] < objective:
            at = at + SHARES[chosen] * step
            damped = max(LEAST_DAMPED, damped / 10) if SHARES[chosen] >= 0.6 else damped * 10 if SHARES[chosen] <= 0.1 else damped
            found = at_point(at, h)
        elif damped < 1.0:
            damped = min(1.0, damped * 100)
        else:
            break
    return min(best, (found[0], at), key=lambda b: b[0])[1]


def fit_support(counted: DataFrame, positive: float, size: int, gamma: float, seed: int, penalty: float, iterations: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Weights of the Fourier features and intercept, of the label ``positive`` against all others, over ``equal_rows``."""

    def solve(total) -> np.ndarray:
        rows, scaled = scaling(total, size)

        def look(at, h):
            return total(lambda z, y, n: hinge_parts(z, y, n, scaled, at, h))

        def compare(at, step, h):
            return total(lambda z, y, n: hinge_losses(z, y, n, scaled, at, step, h))

        at = descend(look, compare, size + 1, rows, penalty, iterations, tolerance)
        return np.append(at[:-1] * scaled, at[-1])

    side = F.when(F.col("y") == positive, 1.0).otherwise(-1.0)
    found = solved(counted.withColumn("y", side), size, gamma, seed, solve)
    return found[:-1], float(found[-1])


def stored_support(spark: SparkSession, weights: np.ndarray, intercept: float, params: dict) -> LinearSVCModel:
    """An MLlib model with these weights."""
    return stored(spark, LinearSVCModel, "org.apache.spark.ml.classification.LinearSVCModel", weights, intercept, params)

