"""Binomial logistic regression by Newton steps, many sets of predictors at a time.

Rows are counted by their predictors first, so a pass reads each pattern once, with its rows and events. One pass gives the
likelihood, gradient and information matrix of all sets of predictors that are being fitted; what comes to the driver are
matrices of the number of predictors squared. Criteria come from events and rows, not from patterns, so they do not depend on the grouping.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.passes import matrix, spread, summed
from tallyforge.session import materialise

#: A step whose gain in likelihood is below this, relative to it, is the last.
TOLERANCE = 1e-12
#: Newton steps before a fit is given up. One with a maximum takes about ten; without, as when predictors separate the outcomes, the
#: gain only falls by a constant factor from step to step.
STEPS = 25


class NotConverged(ArithmeticError):
    """The likelihood has no maximum within reach, as when predictors separate the outcomes."""


@dataclass(frozen=True)
class Patterns:
    """Distinct values of the predictors with their rows and events, written; and how predictors are scaled inside."""

    rows: DataFrame
    names: list[str]
    means: np.ndarray
    widths: np.ndarray
    n: int
    events: int


@dataclass(frozen=True)
class Fit:
    """Coefficients with the intercept last, their covariance, and the log likelihood."""

    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    likelihood: float

    @property
    def aic(self) -> float:
        return 2 * (len(self.names) + 1) - 2 * self.likelihood

    @property
    def errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    @property
    def p_values(self) -> list[float]:
        with np.errstate(divide="ignore", invalid="ignore"):
            return [math.erfc(abs(z) / math.sqrt(2)) for z in self.coefficients / self.errors]


def patterns(df: DataFrame, y: str, xs: Sequence[str]) -> Patterns:
    """Count the complete rows by their predictors; ``y`` is 0 or 1."""
    xs = list(xs)
    named = df.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).na.drop()
    inner = [f"x{i}" for i in range(len(xs))]
    held = materialise(named.groupBy(*inner).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("events")), "patterns")
    total = held.agg(F.sum("n").alias("n"), F.sum("events").alias("events")).first()
    if not total["n"]:
        raise ValueError("no complete rows")
    means, widths = spread(held, inner) if inner else (np.zeros(0), np.zeros(0))
    return Patterns(held, xs, means, widths, int(total["n"]), int(total["events"]))


def _moments(held: Patterns, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Likelihood, gradient, information and the largest linear predictor for every row of ``weights``, in one pass."""
    many, p = weights.shape
    inner, means, widths = [f"x{i}" for i in range(p - 1)], held.means, held.widths

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        n, events = (batch.column(c).to_numpy() for c in ("n", "events"))
        x = np.column_stack([(matrix(batch, inner) - means) / widths, np.ones(len(n))]) if inner else np.ones((len(n), 1))
        eta = x @ weights.T
        log1p = np.logaddexp(0, eta)
        mu = np.exp(eta - log1p)
        out = np.empty((many, 1 + p + p * p))
        out[:, 0] = events @ eta - n @ log1p
        out[:, 1:1 + p] = (events[:, None] - n[:, None] * mu).T @ x
        for j in range(many):
            out[j, 1 + p:] = ((x * (n * mu[:, j] * (1 - mu[:, j]))[:, None]).T @ x).ravel()
        return out

    sums = summed(held.rows, partial, many, 1 + p + p * p)
    return sums[:, 0], sums[:, 1:1 + p], sums[:, 1 + p:].reshape(many, p, p)


def fit_sets(held: Patterns, sets: Sequence[Sequence[str]]) -> list[Fit]:
    """Fit the outcome on every one of several sets of predictors; each step of all of them is one pass.

    A step that loses likelihood is halved. Raises ``NotConverged`` if any set has no maximum.
    """
    p = len(held.names) + 1
    used = np.array([[x in s for x in held.names] + [True] for s in map(set, sets)]).reshape(len(sets), p)
    rate = min(max(held.events / held.n, 1e-12), 1 - 1e-12)
    at = np.zeros((len(sets), p))
    at[:, -1] = math.log(rate / (1 - rate))
    best, gradient, information = _moments(held, at)
    step = np.zeros_like(at)
    active = np.ones(len(sets), bool)

    def newton(j: int) -> np.ndarray:
        on, move = used[j], np.zeros(p)
        move[on] = np.linalg.pinv(information[j][np.ix_(on, on)], hermitian=True) @ gradient[j][on]
        return move

    for j in range(len(sets)):
        step[j] = newton(j)
    for _ in range(STEPS):
        gain = np.einsum("jp,jp->j", step, gradient)
        done = active & (gain <= TOLERANCE * (1 + np.abs(best)))
        at[done] += step[done]  # of second order: what it gains is below what is counted
        active &= ~done
        if not active.any():
            break
        todo = np.flatnonzero(active)
        found, slope, info = _moments(held, at[todo] + step[todo])
        for i, j in enumerate(todo):
            if found[i] >= best[j] - TOLERANCE * abs(best[j]):
                at[j], best[j], gradient[j], information[j] = at[j] + step[j], found[i], slope[i], info[i]
                step[j] = newton(j)
            else:
                step[j] /= 2
    if active.any() or held.events in (0, held.n):
        raise NotConverged(f"no maximum of the likelihood for {[sorted(sets[j]) for j in range(len(sets))]}")
    fits = []
    for j, names in enumerate(sets):
        names = [x for x in held.names if x in set(names)]
        on = np.flatnonzero(used[j])
        # from scaled predictors back to given ones
        back = np.diag(np.append(1 / held.widths, 1.0)[on])
        back[-1, :-1] = -(held.means / held.widths)[on[:-1]]
        covariance = back @ np.linalg.pinv(information[j][np.ix_(on, on)], hermitian=True) @ back.T
        fits.append(Fit(names, back @ at[j][on], covariance, float(best[j])))
    return fits
