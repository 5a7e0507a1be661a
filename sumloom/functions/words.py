"""Words: the language in which iterated sums are asked for.

A word is a sequence of *brackets*. In a simple word a bracket is a monomial, ``[112]`` for x1^2 x2
and ``[(-1)2]`` for x2 / x1; in a general word it is a product of registered letters of dimensions,
``[ABS(1)DIM(2)]``. Words are plain immutable values; two words are equal if they ask for the same
sums with the same weights.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement, product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS: dict[str, tuple[Callable[[Column], Column], Callable[[np.ndarray], np.ndarray]]] = {}


def letter(name: str, column: Callable[[Column], Column], array: Callable[[np.ndarray], np.ndarray]) -> str:
    """Register a letter: the same function of one dimension for columns and for arrays."""
    if name in _LETTERS:
        raise ValueError(f"letter {name} exists")
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name!r} is no letter name")
    _LETTERS[name] = (column, array)
    return name


letter("DIM", lambda c: c, lambda x: x)
letter("ABS", F.abs, np.abs)


@dataclass(frozen=True)
class Monomial:
    """Exponents by dimension (from 0), without zeros, sorted."""

    powers: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, dims: Iterable[int]) -> Monomial:
        """From 1-based dimensions; a negative one divides; opposite signs cancel."""
        total: dict[int, int] = {}
        for d in dims:
            total[abs(d) - 1] = total.get(abs(d) - 1, 0) + (1 if d > 0 else -1)
        return cls(tuple(sorted((d, n) for d, n in total.items() if n)))

    @property
    def dims(self) -> set[int]:
        return {d for d, _ in self.powers}

    def __str__(self) -> str:
        return "[" + "".join((str(d + 1) if n > 0 and d < 9 else f"({d + 1 if n > 0 else -d - 1})") * abs(n) for d, n in self.powers) + "]"


@dataclass(frozen=True)
class Product:
    """Registered letters with their dimensions (from 0)."""

    factors: tuple[tuple[str, int], ...]

    @property
    def dims(self) -> set[int]:
        return {d for _, d in self.factors}

    def __str__(self) -> str:
        return "[" + "".join(f"{name}({d + 1})" for name, d in self.factors) + "]"


def _rounded(alpha, n: int) -> tuple[float, ...]:
    """Weights in single precision, as sums with weights use them."""
    values = (1.0,) * n if alpha is None else tuple(alpha)
    if len(values) != n:
        raise ValueError(f"{len(values)} weights for a word of length {n}")
    return tuple(float(np.float32(a)) for a in values)


@dataclass(frozen=True)
class Word:
    brackets: tuple[Monomial | Product, ...]
    alpha: tuple[float, ...] = field(default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "alpha", _rounded(self.alpha or None, len(self.brackets)))

    @property
    def simple(self) -> bool:
        return all(isinstance(b, Monomial) for b in self.brackets)

    def weighted(self, alpha: Iterable[float]) -> Word:
        return Word(self.brackets, tuple(alpha))

    def __mul__(self, other: Word) -> Word:
        return Word(self.brackets + other.brackets, self.alpha + other.alpha)

    def __len__(self) -> int:
        return len(self.brackets)

    def __iter__(self) -> Iterator[Monomial | Product]:
        return iter(self.brackets)

    def prefix(self, n: int) -> Word:
        return Word(self.brackets[:n], self.alpha[:n])

    @property
    def dims(self) -> set[int]:
        return set().union(*(b.dims for b in self.brackets)) if self.brackets else set()

    def __str__(self) -> str:
        return "".join(map(str, self.brackets))


_SIMPLE = re.compile(r"(?:\[(?:-?\d|\(-?\d+\))+\])+")
_GENERAL = re.compile(r"(?:\[(?:[A-Za-z_]\w*\(\d+\))+\])+")


def word(text: str, alpha: Iterable[float] | None = None) -> Word:
    """Parse ``[11][2]``, ``[(12)(-1)]`` or ``[ABS(1)DIM(2)][DIM(1)]``."""
    bodies = re.findall(r"\[([^\]]*)\]", text)
    if _SIMPLE.fullmatch(text):
        brackets = []
        for body in bodies:
            dims = [int(a or b) for a, b in re.findall(r"\((-?\d+)\)|(-?\d)", body)]
            if 0 in dims:
                raise ValueError(f"dimension 0 in {text}")
            brackets.append(Monomial.of(dims))
        return Word(tuple(brackets), tuple(alpha or ()))
    if _GENERAL.fullmatch(text):
        found = tuple(Product(tuple((name, int(d) - 1) for name, d in re.findall(r"([A-Za-z_]\w*)\((\d+)\)", body))) for body in bodies)
        unknown = sorted({name for p in found for name, _ in p.factors} - set(_LETTERS))
        if unknown or any(d < 0 for p in found for _, d in p.factors):
            raise ValueError(f"unknown letters {unknown} or dimension 0 in {text}")
        return Word(found, tuple(alpha or ()))
    raise ValueError(f"{text!r} is no word")


def of_weight(weight: int, dims: int = 1) -> list[Word]:
    """All simple words with exactly ``weight`` letters over dimensions 1..dims, shortest first."""

    def compositions(n: int) -> Iterator[tuple[int, ...]]:
        if not n:
            yield ()
        for first in range(1, n + 1):
            for rest in compositions(n - first):
                yield (first, *rest)

    monomials = {n: [Monomial.of(c) for c in combinations_with_replacement(range(1, dims + 1), n)] for n in range(1, weight + 1)}
    found = [Word(b) for parts in compositions(weight) for b in product(*(monomials[n] for n in parts))]
    return sorted(found, key=lambda w: (len(w), str(w)))


def replace_letters(w: Word, names: Iterable[str]) -> Word:
    """A simple word as a general one: letters are drawn from ``names`` in turn, ``DIM`` after them."""
    source = iter(names)
    out = []
    for b in w:
        if any(n < 0 for _, n in b.powers):
            raise ValueError("a negative exponent has no letter")
        out.append(Product(tuple((next(source, "DIM"), d) for d, n in b.powers for _ in range(n))))
    return Word(tuple(out), w.alpha)


def alternate_sign(words: Iterable[Word]) -> list[Word]:
    """Each simple word twice, with exponents that alternate in sign from bracket to bracket: first
    starting with minus, then starting with plus."""
    out = []
    for w in words:
        for start in (-1, 1):
            out.append(Word(tuple(Monomial(tuple((d, n * start * (-1) ** i) for d, n in b.powers)) for i, b in enumerate(w)), w.alpha))
    return out


def column_value(b: Monomial | Product, dims: list[Column], additive: bool) -> Column:
    """A bracket as a column: a product, or a sum where the semiring multiplies by adding."""
    join = (lambda x, y: x + y) if additive else (lambda x, y: x * y)
    if isinstance(b, Product):
        return reduce(join, [_LETTERS[name][0](dims[d]) for name, d in b.factors])
    if additive:
        return reduce(join, [dims[d] * float(n) for d, n in b.powers]) if b.powers else F.lit(0.0)
    # pow() gives infinity where a division by zero would be an error.
    return reduce(join, [dims[d] if n == 1 else F.pow(dims[d], F.lit(float(n))) for d, n in b.powers]) if b.powers else F.lit(1.0)


def array_value(b: Monomial | Product, x: np.ndarray, additive: bool) -> np.ndarray:
    """A bracket on a cube [series, dimension, step]."""
    join = np.add if additive else np.multiply
    if isinstance(b, Product):
        return reduce(join, [_LETTERS[name][1](x[:, d]) for name, d in b.factors])
    if not b.powers:
        return np.full((x.shape[0], x.shape[2]), 0.0 if additive else 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return reduce(join, [x[:, d] * n if additive else x[:, d] ** float(n) for d, n in b.powers])


@dataclass(frozen=True)
class Node:
    parent: int
    bracket: Monomial | Product
    alpha: float
    depth: int


@dataclass(frozen=True)
class Trie:
    """Words that share their beginnings. ``nodes`` come after their parents (-1: none);
    ``emit``: the node of each output, in order; ``labels``: the word of each output."""

    nodes: tuple[Node, ...]
    emit: tuple[int, ...]
    labels: tuple[str, ...]

    @classmethod
    def of(cls, words: Iterable[Word], prefixes: bool) -> Trie:
        """``prefixes``: an output for each distinct prefix, word by word, shortest first; else one for
        each word."""
        nodes, emit, labels, at, seen = [], [], [], {}, set()
        for w in words:
            if not len(w):
                raise ValueError("an empty word has no sum")
            here = -1
            for i, (b, a) in enumerate(zip(w.brackets, w.alpha, strict=True)):
                step = (here, b, a)
                if step not in at:
                    at[step] = len(nodes)
                    nodes.append(Node(here, b, a, i + 1))
                here = at[step]
                if prefixes and here not in seen:
                    seen.add(here)
                    emit.append(here)
                    labels.append(str(w.prefix(i + 1)))
            if not prefixes:
                emit.append(here)
                labels.append(str(w))
        return cls(tuple(nodes), tuple(emit), tuple(labels))
