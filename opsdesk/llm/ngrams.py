"""Hashed character n-grams of one text, as numpy arrays; used inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def hashed(text: str, sizes: tuple[int, int], bits: int) -> np.ndarray:
    """Buckets (below 2**bits) of every n-gram of the text for all n from sizes[0] to sizes[1], with repeats."""
    cp = code_points(text)
    parts, h = [], np.zeros(len(cp) + 1, np.uint64)
    for n in range(1, sizes[1] + 1):
        if len(cp) < n:
            break
        h = (h[: len(cp) - n + 1] + cp[n - 1 :] + np.uint64(1)) * _STEP
        if n >= sizes[0]:
            x = (h ^ (h >> np.uint64(29))) * _MIX
            parts.append((x >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Distinct:
    """Distinct values of small-integer arrays without sorting: the last writer of each slot is its representative."""

    def __init__(self, size: int):
        self.slot = np.zeros(size, np.int32)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = np.arange(len(values), dtype=np.int32)
        self.slot[values] = at
        return values[self.slot[values] == at]


def slices(n: int, step: int) -> Iterator[slice]:
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))
