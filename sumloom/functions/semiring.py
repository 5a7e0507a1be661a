"""Semirings in which words are summed, for columns and for arrays.

``strict``: positions in a word increase strictly (i1 < i2 < ...), else weakly. ``additive``: the
semiring multiplies by adding, so brackets are sums and weights are added to exponents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sumloom.functions.arrays import running


@dataclass(frozen=True)
class Semiring:
    """``running``: the semiring's sum over a window of a column; ``accumulate``: the same along the
    last axis of an array; ``times``: the product of two columns or arrays; ``zero``: neutral in sums;
    ``plus``: the sum of two columns, of two arrays (weights of a wide range and blocked sums need it).

    A semiring of one's own needs these and works wherever Reals, Arctic and Bayesian do.
    """

    name: str
    running: Callable[[Column], Column]
    accumulate: Callable[[np.ndarray], np.ndarray]
    times: Callable
    zero: float
    strict: bool
    additive: bool
    plus: tuple[Callable, Callable] | None = None

    def before_array(self, p: np.ndarray) -> np.ndarray:
        """What a next letter multiplies: the running sum up to the step, or the step before."""
        if not self.strict:
            return p
        out = np.full_like(p, self.zero)
        out[:, 1:] = p[:, :-1]
        return out


def Reals() -> Semiring:  # noqa: N802
    """(+, *), strict."""
    return Semiring("Reals", F.sum, lambda z: running(np.add, z), lambda a, b: a * b, 0.0, True, False, (lambda a, b: a + b, np.add))


def Arctic() -> Semiring:  # noqa: N802
    """(max, +), weak."""
    return Semiring("Arctic", F.max, lambda z: running(np.maximum, z), lambda a, b: a + b, float("-inf"), False, True, (F.greatest, np.maximum))


def Bayesian() -> Semiring:  # noqa: N802
    """(max, *), weak; meant for values in [0, 1]."""
    return Semiring("Bayesian", F.max, lambda z: running(np.maximum, z), lambda a, b: a * b, float("-inf"), False, False, (F.greatest, np.maximum))
