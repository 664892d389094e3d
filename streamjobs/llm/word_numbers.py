"""Exact numbers for the words and three-word windows of one text, for use inside tasks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np

_EXACT = 1 << 21  # three numbers below it fit a 64-bit integer


def windows_of_three(words: Sequence[bytes]) -> np.ndarray:
    """One number per three-word window of a text, in order; equal numbers if and only if equal windows."""
    n = len(words)
    if n < 3:
        return np.empty(0, np.int64)
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    pairs = ids[:-1] * n + ids[1:]
    if n >= _EXACT:
        pairs = np.unique(pairs, return_inverse=True)[1]
    return pairs[:-1] * n + ids[2:]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys as numbers from 0 in their order, and how often the key at each place occurs."""
    _, ids, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return ids, counts[ids]
