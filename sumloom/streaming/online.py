"""Iterated sums of series that arrive step by step.

Sums without a weighting are online: a series' state is one number for each node of the trie. A
stateful map keeps it by series and emits the sums after each step, in the order of ``order``
inside a batch of arrivals; steps must arrive in order. Weightings, STD and NRM need the whole
series, so they have no online form.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from sumloom.functions.words import array_value
from sumloom.operators.sums import IteratedSums


def advance(sums: IteratedSums, x: np.ndarray, state: list[float] | None) -> tuple[np.ndarray, list[float]]:
    """Sums after each of the new steps x [dimension, step], and the state after the last."""
    ring, trie = sums.semiring, sums.trie
    state = [ring.zero] * len(trie.nodes) if state is None else list(state)
    cube, before, after = x[None], [], []
    for i, n in enumerate(trie.nodes):
        z = array_value(n.bracket, cube, ring.additive)
        if n.parent >= 0:
            z = ring.times(before[n.parent], z)
        p = ring.accumulate(np.concatenate([np.full((1, 1), state[i]), z], axis=1))
        after.append(p[:, 1:])
        before.append(p[:, :-1] if ring.strict else p[:, 1:])
        state[i] = float(p[0, -1])
    return np.stack([after[i][0] for i in trie.emit]), state


def online_sums(stream: DataFrame, sums: IteratedSums, dims: list[str], key: str = "series_id", order: str = "t") -> DataFrame:
    """key, order, s1, s2, ... for every arriving row of a streaming DataFrame."""
    if sums.weighting is not None:
        raise ValueError("a weighting needs the whole series")
    types = dict(stream.dtypes)
    names = [f"s{i + 1}" for i in range(len(sums))]
    schema = ", ".join([f"`{key}` {types[key]}", f"`{order}` {types[order]}", *(f"{n} double" for n in names)])

    def run(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        held = pickle.loads(state.get[0]) if state.exists else None
        out, held = advance(sums, rows[dims].to_numpy(dtype=float).T, held)
        state.update((pickle.dumps(held),))
        yield pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), **dict(zip(names, out, strict=True))})

    return stream.select(key, order, *dims).groupBy(key).applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.NoTimeout)
