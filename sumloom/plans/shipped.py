"""Pipelines that ship with the library: general, reduced, and invariant under time warping."""

from __future__ import annotations

from sumloom.functions.paths import L1, Indices
from sumloom.functions.semiring import Arctic, Reals
from sumloom.functions.words import alternate_sign, of_weight, word
from sumloom.operators import prepare as P
from sumloom.operators import sieves as S
from sumloom.operators.sums import CosineSums, IteratedSums
from sumloom.plans.pipeline import Pipeline, Slice

_UPPER = (0.5, 1.0)


def _sieves() -> tuple:
    return (*(S.NPI(q=_UPPER, inc=i) for i in range(3)), *(S.MPI(q=_UPPER, inc=i) for i in range(3)), S.END())


def mixed(weight: int, arctic_length: int, cosine_weight: int, name: str) -> Pipeline:
    """Weighted sums in the Reals, long alternating Arctic words, and cosine sums at two exponents,
    over a series and its increments."""
    twice = P.NEW(P.INC())
    half = arctic_length // 2
    zigzag = alternate_sign(word(w) for w in ("[1]" * arctic_length, "[2]" * arctic_length, "[1][2]" * half, "[2][1]" * half))
    cosine_words = tuple(w for k in range(1, cosine_weight + 1) for w in of_weight(k, 2))
    freqs = tuple(i / 20 for i in range(1, 11, 2))
    slices = [
        Slice((twice, P.STD()), (IteratedSums(tuple(of_weight(weight, 2)), True, Reals(), Indices()),), _sieves(), 1.0),
        Slice((twice,), (IteratedSums(tuple(zigzag), True, Arctic()),), _sieves(), 1.0),
        *(Slice((twice, P.STD()), (CosineSums(cosine_words, freqs, e, True),), _sieves(), 1.0) for e in (1, 2)),
    ]
    return Pipeline(tuple(slices), name)


def general() -> Pipeline:
    return mixed(6, 48, 4, "general")


def reduced() -> Pipeline:
    return mixed(4, 24, 3, "reduced")


def time_warping_invariant() -> Pipeline:
    sums = IteratedSums(tuple(of_weight(9, 1)), True, Reals(), L1())
    zigzag = IteratedSums(tuple(alternate_sign([word("[1]" * 48)])), True, Arctic())
    return Pipeline((Slice((P.INC(),), (sums,), (S.NPI(), S.MPI(), S.END()), 1.0), Slice((), (zigzag,), (S.NPI(), S.END()), 1.0)), "time warping invariant")
