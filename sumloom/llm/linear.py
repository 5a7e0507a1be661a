"""Hashed byte-trigram features of texts, for the learned operators."""

from __future__ import annotations

import numpy as np

from sumloom.llm.common import U64, mix


def trigram_slots(buf: np.ndarray, bounds: np.ndarray, dims: int, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the trigram that starts at each byte, and bounds of the documents in it; trigrams
    don't cross documents."""
    if fold is not None:
        buf = fold[buf]
    n = np.maximum(np.diff(bounds) - 2, 0)
    cuts = np.concatenate([[0], np.cumsum(n)])
    if len(buf) < 3:
        return np.empty(0, np.int64), cuts * 0
    code = buf[:-2].astype(np.uint32) << np.uint32(16) | buf[1:-1].astype(np.uint32) << np.uint32(8) | buf[2:]
    slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)
    inside = np.ones(len(slot), dtype=bool)
    for back in (1, 2):
        at = bounds[1:-1] - back
        inside[at[(at >= 0) & (at < len(slot))]] = False
    return slot[inside], cuts


def segment_sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of x between cuts, 0 where nothing lies between."""
    out, full = np.zeros(len(cuts) - 1), cuts[1:] > cuts[:-1]
    if full.any():
        out[full] = np.add.reduceat(x[: cuts[-1]], cuts[:-1][full], dtype=np.float64)
    return out


def stable_unit(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each integer."""
    return (mix(ids.astype(np.int64).view(U64) + U64(seed)) >> U64(11)).astype(np.float64) / float(1 << 53)
